"""The task queue as a stream: micro-batches of tasks, handled in priority order, with a status table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.parsing import payload
from rivulet.functions.text import present
from rivulet.plans.ingestion import as_entries
from rivulet.plans.language_model import extract_facts, verify
from rivulet.sources.readers import with_context
from rivulet.tables import Work, union_all

TASK = "id bigint, task_type string, payload string, priority int"
#: Task types that wait for a language model; without one the other kinds are unknown.
KNOWN = ["decompose", "verify"]


def queue_order(tasks: DataFrame) -> DataFrame:
    """Pending tasks with null priority as 5; the order is priority descending, then id."""
    # what a JSON payload is about: the text, or the field of its kind of task
    about = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("text", "topic", "question", "entry_id")], payload(F.col("payload")))
    return tasks.select("id", "task_type", about.alias("text"), F.coalesce("priority", F.lit(5)).alias("priority"))


def next_tasks(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` tasks to take next."""
    return queue_order(tasks).orderBy(F.desc("priority"), "id").limit(n)


def offline_handler(batch: DataFrame) -> DataFrame:
    """(id, task_type, text, priority, status, result): without a language model unknown kinds are reported, and known
    ones stay pending until a run that has one."""
    known = F.coalesce(F.col("task_type").isin(KNOWN), F.lit(False))
    said = F.concat(F.lit("unknown task type: "), F.coalesce("task_type", F.lit("null")))
    return batch.select("id", "task_type", "text", "priority", F.when(known, "pending").otherwise("done").alias("status"), F.when(known, "no language model").otherwise(said).alias("result"))


def agent_handler(store: DataFrame, model, facts: str, verdicts: str, domains: V.Domains | None = None) -> Callable[[DataFrame], DataFrame]:
    """A handler that works tasks off with a language model.

    Research, question and decompose tasks append their entries (of the
    priority of their task, higher ones first when they are stored) to the
    Parquet table ``facts``; verify tasks, whose payload names an entry by
    ``entry_id`` or as its text, append (id, truth, evidence) to ``verdicts``.
    A task without an answer is done with the result 'no answer'.
    """

    def handle(batch: DataFrame) -> DataFrame:
        work = Work(batch.sparkSession, "agent")
        tasks = work.put(batch)
        kinds = {"research": ("facts", "agent:research", "agent research: ", True), "question": ("question", "agent:question", "agent Q&A: ", True), "decompose": ("decompose", "agent:decompose", "agent decomposition", False)}
        found = []
        for kind, (prompt, source, said, named) in kinds.items():
            own = tasks.filter(F.col("task_type") == kind).select("id", "text", "priority")
            lines = extract_facts(own, "id", "text", prompt, model).filter(present("subject") & present("predicate") & present("object"))
            lines = lines if kind == "question" else lines.withColumn("truth_value", F.lit("T"))
            lines = with_context(lines, domains).join(own, "id")
            evidence = F.concat(F.lit(said), "text") if named else F.lit(said)
            rows = as_entries(lines.withColumn("id", F.col("id") * 1_000_000 + F.col("line_no")), F.lit(source), evidence).join(lines.select((F.col("id") * 1_000_000 + F.col("line_no")).alias("id"), F.col("id").alias("task"), "priority"), "id")
            found.append(rows)
        new = work.put(union_all(found))
        new.write.mode("append").parquet(facts)
        asked = tasks.filter("task_type = 'verify'").select(F.col("id").alias("task"), F.expr("try_cast(text AS bigint)").alias("id"))
        judged = work.put(verify(store.join(asked.select("id").distinct(), "id", "left_semi"), model))
        judged.write.mode("append").parquet(verdicts)
        counts = new.groupBy(F.col("task").alias("id")).agg(F.concat(F.lit("added "), F.count(F.lit(1)), F.lit(" facts")).alias("said"))
        said = counts.unionByName(asked.join(judged, "id").select(F.col("task").alias("id"), F.concat(F.lit("verdict: "), "truth").alias("said")))
        known = F.coalesce(F.col("task_type").isin(*kinds, "verify"), F.lit(False))
        unknown = F.concat(F.lit("unknown task type: "), F.coalesce("task_type", F.lit("null")))
        done = tasks.join(said, "id", "left")
        return done.select("id", "task_type", "text", "priority", F.lit("done").alias("status"), F.when(known, F.coalesce("said", F.lit("no answer"))).otherwise(unknown).alias("result"))

    return handle


STATUS = "id bigint, task_type string, text string, priority int, status string, result string"


def outcomes(spark: SparkSession, status: str) -> DataFrame:
    """The last outcome of every task, with the batch that had it; an empty table before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(status)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{STATUS}, batch bigint")
    rows = spark.read.schema(f"{STATUS}, batch bigint").parquet(status)
    return rows.groupBy("id").agg(F.max_by(F.struct("task_type", "text", "priority", "status", "result"), "batch").alias("o"), F.max("batch").alias("batch")).select("id", "o.*", "batch")


#: Runs without new files that may come between two batches of the stream.
_EXTRA = 1_000_000


def run_queue(spark: SparkSession, source: str, status: str, checkpoint: str, handler: Callable[[DataFrame], DataFrame] = offline_handler, files_per_batch: int = 100) -> None:
    """Handle every task file below ``source`` (JSON lines) once and append the outcomes to the Parquet table ``status``.

    Tasks are taken in order of priority, then id; the outcomes of a batch are
    stored in that order.  Tasks that stayed pending are taken up again with
    the next batch, or at the end of a run without new files.  Each batch is
    one partition folder of the table, overwritten when it runs again after a
    failure, so every task has one last outcome.
    """
    stream = spark.readStream.schema(TASK).option("maxFilesPerTrigger", files_per_batch).json(source)
    ran = []

    def work_off(tasks: DataFrame, folder: int) -> None:
        handler(tasks).orderBy(F.desc("priority"), "id").write.mode("overwrite").parquet(f"{status}/batch={folder}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = _EXTRA * (batch_id + 1)
        left = outcomes(spark, status).filter((F.col("status") == "pending") & (F.col("batch") < folder)).select("id", "task_type", "text", "priority")
        work_off(queue_order(batch).unionByName(left), folder)
        ran.append(folder)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not ran:
        known = outcomes(spark, status)
        left = known.filter("status = 'pending'").select("id", "task_type", "text", "priority")
        last = known.agg(F.max("batch")).first()[0]
        if last is not None and not left.isEmpty():
            if (last + 1) % _EXTRA == 0:
                raise RuntimeError("too many runs without a new task file")
            work_off(left, last + 1)
