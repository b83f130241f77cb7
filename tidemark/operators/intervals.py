"""Interval, as-of and evidence-chain joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covered_by(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, width: int = 1024) -> DataFrame:
    """Points joined to the ranges of their key that contain them.

    Ranges are cut into cells of `width`, so that the join is an equi-join on (key, cell) and stays linear in the
    points even where one stream holds most of them.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [key, "_cell"]).where(F.col(at).between(F.col(first), F.col(last))).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one sort, no range join."""
    a = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side"))
    b = right.select(*key, at, *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return both.withColumn("_seen", seen).where("_side = 1").select(*left.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])


def evidence_chain(decisions: DataFrame, links: Sequence[tuple[str, DataFrame]], key: str = "decision_id") -> DataFrame:
    """Decisions with whether each link of evidence exists, and the first that is missing."""
    out = decisions
    for name, table in links:
        out = out.join(table.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    missing = F.coalesce(*[F.when(~F.col(n), F.lit(n)) for n, _ in links])
    return out.withColumns({"missing_link": missing, "complete": missing.isNull()})


def protocol_check(manifests: DataFrame, results: DataFrame, key: str = "experiment_id", digest: str = "protocol_sha256") -> DataFrame:
    """Results against the protocol they were registered under: OK, PROTOCOL_CHANGED or UNREGISTERED."""
    registered = manifests.select(key, F.col(digest).alias("_registered"))
    status = F.when(F.col("_registered").isNull(), "UNREGISTERED").when(F.col("_registered") == F.col(digest), "OK").otherwise("PROTOCOL_CHANGED")
    return results.join(registered, key, "left").withColumn("protocol_status", status).drop("_registered")


def conclusion(p: str, effect: str, valid: str, registered: str) -> Column:
    """SUPPORTS, REFUTES or INCONCLUSIVE from a registered, valid result."""
    usable = F.col(valid) & (F.col("protocol_status") == "OK")
    return F.when(~usable | (F.col(p) >= 0.05), "INCONCLUSIVE").when(F.signum(effect) == F.signum(registered), "SUPPORTS").otherwise("REFUTES")
