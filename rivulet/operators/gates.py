"""Which properties pass along a chain of two facts, and learning it from outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet import vocabulary as V


class Rules:
    """The predicate classes; immutable, ``with_`` gives changed copies."""

    def __init__(self, transparent=None, opaque=None, semi=None, intrinsic=None, relational=None, identity=None, allowed=()):
        pick = lambda given, default: sorted(set(default if given is None else given))
        self.transparent, self.opaque, self.semi = pick(transparent, V.TRANSPARENT_LINKS), pick(opaque, V.OPAQUE_LINKS), pick(semi, V.SEMI_TRANSPARENT_LINKS)
        self.intrinsic, self.relational, self.identity = pick(intrinsic, V.INTRINSIC), pick(relational, V.RELATIONAL), pick(identity, V.IDENTITY)
        self.allowed = sorted(allowed)

    def with_(self, **changes) -> Rules:
        return Rules(**(self.__dict__ | changes))

    def _flags(self, link: Column, inherited: Column) -> dict[str, Column]:
        link, inherited = F.lower(link), F.lower(inherited)
        return {
            "transparent": link.isin(self.transparent),
            "semi": link.isin(self.semi),
            "closed": link.isin(sorted({*self.opaque, *self.semi})),
            "intrinsic": inherited.isin(self.intrinsic),
            "relational": inherited.isin(self.relational),
            "identity": inherited.isin(self.identity),
            "sized": (link == "profile_size") | (inherited == "profile_size"),
            "override": F.concat_ws("|", link, inherited).isin([f"{a}|{b}" for a, b in self.allowed]) if self.allowed else F.lit(False),
        }

    def verdict(self, link: Column, inherited: Column) -> Column:
        """The first rule that holds: allow:<why> or block:<why>."""
        f = self._flags(link, inherited)
        return (
            F.when(f["override"], "allow:override")
            .when(f["transparent"], "allow:transparent")
            .when(f["semi"] & f["identity"], "allow:identity")
            .when(f["closed"] & f["intrinsic"], "block:intrinsic")
            .when(f["closed"] & f["relational"], "allow:relational")
            .when(f["sized"], "block:profile_size")
            .when(f["closed"], "allow:unverified")
            .otherwise("allow:default")
        )

    def allows(self, link: Column, inherited: Column) -> Column:
        return F.startswith(self.verdict(link, inherited), F.lit("allow"))

    def confidence(self, link: Column, inherited: Column) -> Column:
        """0.0 blocked, 0.9 transparent, 0.6 semi-transparent, 0.4 opaque and relational, else 0.3."""
        f = self._flags(link, inherited)
        return (
            F.when(~self.allows(link, inherited), 0.0).when(f["transparent"], 0.9).when(f["semi"], 0.6)
            .when(F.lower(link).isin(self.opaque) & f["relational"], 0.4).otherwise(0.3)
        )


def parse_chain_evidence(c: Column) -> tuple[Column, Column]:
    """(link, inherited) of an evidence text ``transitive[p→q]: …``; empty strings where it is another text."""
    pattern = r"transitive\[([\p{L}\p{N}_]+)→([\p{L}\p{N}_]+)\]:"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def pair_stats(outcomes: DataFrame) -> DataFrame:
    """(link, inherited, approved, rejected, total) from one row per judged chain (link, inherited, approved)."""
    return outcomes.groupBy("link", "inherited").agg(
        F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"), F.count(F.lit(1)).alias("total")
    )


def suggest_rules(stats: DataFrame, min_samples: int = 5, threshold: float = 0.75) -> DataFrame:
    """``stats`` with ``suggestion``: block or allow by the share of rejections or approvals, else uncertain."""
    enough = F.col("total") >= min_samples
    s = F.when(enough & (F.col("rejected") / F.col("total") >= threshold), "block").when(enough & (F.col("approved") / F.col("total") >= threshold), "allow").otherwise("uncertain")
    return stats.withColumn("suggestion", s)


def apply_rules(rules: Rules, suggestions: DataFrame, unblock: bool = False) -> Rules:
    """Learned rules as a new ``Rules``.  A block adds the inherited predicate to the intrinsic ones, and an unknown
    link to the opaque ones; an allow adds it to the relational ones.  As an intrinsic predicate blocks before a
    relational one allows, an allow alone lifts no block; ``unblock`` adds the pair to the overrides.  All suggestions
    count: what comes to the driver are names of predicates, a vocabulary."""
    opaque, intrinsic, relational, allowed = set(rules.opaque), set(rules.intrinsic), set(rules.relational), set(rules.allowed)
    names = lambda kind, c: {r[0] for r in suggestions.filter(F.col("suggestion") == kind).select(c).distinct().collect()}
    intrinsic |= names("block", "inherited")
    opaque |= names("block", "link") - set(rules.semi)
    relational |= names("allow", "inherited")
    if unblock:
        allowed |= {(r["link"], r["inherited"]) for r in suggestions.filter("suggestion = 'allow'").select("link", "inherited").distinct().collect()}
    return rules.with_(opaque=opaque, intrinsic=intrinsic, relational=relational, allowed=allowed)
