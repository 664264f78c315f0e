"""Reading tables, cutting lineage and joining on skewed keys.

``materialise`` is the only way the library cuts lineage: a Parquet table under
the folder named by ``spark.checkpoint.dir``, which every executor shares and
which therefore survives the loss of any of them.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than one part in so many of all rows; there can be no more hot keys than that.
HOT_PARTS = 512
#: A key with fewer rows than that is never hot.
HOT_LEAST = 100_000
#: A hot key's rows are spread over so many salts.
SALTS = 32


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A session on one machine that names none gets a private folder, removed
    when its JVM ends.  On a cluster there is no folder to fall back on: tables
    would end up on the disks of single machines, so that is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not on_one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(Path(tempfile.mkdtemp(prefix="rivulet-")).as_uri())
        where = sc.getCheckpointDir()
        _delete_at_end(spark, where.rpartition("/")[0])
    return where.rstrip("/")


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, where: str) -> None:
    """Have the JVM delete a folder when it ends."""
    path, fs = _path(spark, where)
    fs.mkdirs(path)
    fs.deleteOnExit(path)


class Work:
    """A folder of intermediate tables below the shared folder.

    ``put`` writes a table and reads it back; ``drop`` deletes a table that no
    later plan reads.  Results are read from the tables when they are used, so
    the folders stay until ``close`` (of a session) or the end of its JVM.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rivulet-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        """A place for the next table or set of files."""
        if not self.count:
            _delete_at_end(self.spark, self.root)
            _FOLDERS.setdefault(self.spark.sparkContext.applicationId, []).append(self.root)
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._rivulet_path = path
        return back

    def append(self, df: DataFrame, path: str) -> DataFrame:
        """``df`` added to the table at ``path`` (from ``path()``); all of the table."""
        df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_rivulet_path", None)
            if path:
                p, fs = _path(self.spark, path)
                fs.delete(p, True)


def free(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that only finished plans needed; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_FOLDERS: dict[str, list[str]] = {}


def close(spark: SparkSession) -> None:
    """Delete all intermediate tables of a session; results that were not written out can no longer be read."""
    for root in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        p, fs = _path(spark, root)
        fs.delete(p, True)


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> list:
    """Keys whose count ``n`` exceeds one part in HOT_PARTS of ``total`` and HOT_LEAST: at most HOT_PARTS values, whatever the data."""
    least = max(total // HOT_PARTS, HOT_LEAST)
    if total <= least:
        return []
    return [r[0] for r in counted.filter(F.col(n) > least).select(key).collect()]


def hot_of(df: DataFrame, key: str) -> list:
    """The keys of ``df`` that are hot, at most HOT_PARTS of them: the most frequent ones of more than HOT_LEAST rows."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > HOT_LEAST) & F.col(key).isNotNull())
    return [r[0] for r in counted.orderBy(F.desc("n")).limit(HOT_PARTS).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner", spread: str | None = None) -> DataFrame:
    """Equi-join on ``key`` where left rows of a few keys may be a large share.

    ``right`` has few rows per key.  Left rows of the ``hot`` keys (from
    ``hot_keys``) get a salt made of ``spread`` (default: all left columns);
    the right rows of those keys are repeated once per salt.  Null keys never
    match, as in any equi-join, and are spread too.
    """
    if not hot and how != "left":
        return left.join(right, key, how)
    by = F.pmod(F.xxhash64(*([spread] if spread else left.columns)), F.lit(SALTS)).cast("int")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    a = left.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, by).otherwise(F.lit(0)))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn("_salt", F.explode(salts) if hot else F.lit(0))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once a Spark context, as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_rivulet_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rivulet-code-")) / "rivulet_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(str(target))
    sc._rivulet_shipped = True
