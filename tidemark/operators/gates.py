"""Release gates over documents and reports: allowlists, duplicates, placeholders, isolation, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowlisted(found: DataFrame, allow: DataFrame, key: str, errors_pass: bool = True) -> DataFrame:
    """Findings with a verdict: ALLOWED, UNALLOWLISTED, or ERROR where errors never pass; plus STALE allowlist entries.

    The two sides meet once, in a full outer join.  A finding without a key is never allowed, and an allowlist entry
    without one is always stale.
    """
    a = found.select(F.col(key).alias("_f"), "severity", F.lit(True).alias("_found"))
    b = allow.select(F.col(key).alias("_a")).distinct().withColumn("_listed", F.lit(True))
    both = a.join(b, F.col("_f") == F.col("_a"), "full")
    error = F.lit(False) if errors_pass else F.col("severity") == "error"
    verdict = F.when(F.col("_found").isNull(), "STALE").when(error, "ERROR").when(F.col("_listed").isNull(), "UNALLOWLISTED").otherwise("ALLOWED")
    return both.select(F.coalesce("_f", "_a").alias(key), verdict.alias("verdict"))


def thin_rationales(allow: DataFrame, least: int = 20) -> DataFrame:
    """Allowlist entries whose rationale is missing or too short."""
    return allow.where(F.coalesce(F.length(F.trim("rationale")), F.lit(0)) < least)


def net_of(description: Column) -> Column:
    """The net named in square brackets; UNSPECIFIED_NET without one."""
    net = F.regexp_extract(description, r"\[([^\]]+)\]", 1)
    return F.when(net == "", "UNSPECIFIED_NET").otherwise(net)


#: Escapes of JSON for single characters, fixed values.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_string(c: Column) -> Column:
    """A JSON string in ASCII: all else is escaped by its UTF-16 units."""

    def unit(u: Column) -> Column:
        code = F.conv(u, 16, 10).cast("int")
        out = F.when((code >= 32) & (code < 127), F.char(code)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for plain, escape in _SHORT.items():
            out = F.when(code == ord(plain), escape).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), 1)
    text = F.when(c.rlike(r"^[ !#-\[\]-~]*$"), c).otherwise(F.array_join(F.transform(units, unit), ""))
    return F.concat(F.lit('"'), text, F.lit('"'))


def fingerprint(fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """SHA-256 of a JSON object with sorted keys and spaced separators; lists are arrays of strings, sorted."""
    lists = lists or {}
    values = {k: F.coalesce(json_string(v), F.lit("null")) for k, v in fields.items()}
    values |= {k: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.coalesce(v, F.array().cast("array<string>"))), lambda x: F.coalesce(json_string(x), F.lit("null"))), ", "), F.lit("]")) for k, v in lists.items()}
    parts = [F.concat(F.lit(f'"{k}": '), values[k]) for k in sorted(values)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def placeholders(texts: DataFrame, key: str, text: str, words: Sequence[str] = ("TODO", "TBD", "PLACEHOLDER")) -> DataFrame:
    """Keys of texts that still hold a placeholder, and the first one."""
    pattern = "(" + "|".join(words) + ")"
    return texts.where(F.col(text).rlike(pattern)).select(key, F.regexp_extract(text, pattern, 1).alias("found"))


def missing_members(have: Column, wanted: Sequence[str]) -> Column:
    """Required members that an array lacks."""
    return F.array_except(F.array(*[F.lit(w) for w in wanted]), have)


def same_order(have: Column, wanted: Sequence[str]) -> Column:
    return have == F.array(*[F.lit(w) for w in wanted])


#: Words of nets that a board must not have (fixed values).
FORBIDDEN = ("RESONANCE_DRIVE", "R_OUTER_V", "R_CORE_RF", "CHAMBER_HV", "50_OHM_RF")


def forbidden(nets: DataFrame, net: str, keywords: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Nets whose name holds a forbidden keyword: one pattern, not a cross join."""
    return nets.where(F.col(net).rlike("|".join(keywords)))


def manifest_violations(parts: DataFrame, sheets: DataFrame, connectors: DataFrame) -> DataFrame:
    """kind and subject of each fault: repeated references, parts on unknown sheets, human ground on lab connectors."""
    repeated = duplicates(parts, "ref").select(F.lit("DUPLICATE_REF").alias("kind"), F.col("ref").alias("subject"))
    lost = parts.join(sheets, ["board", "sheet"], "left_anti").select(F.lit("UNKNOWN_SHEET"), "ref")
    ground = connectors.where((F.col("domain") == "LAB_ISO") & F.exists("pins", lambda p: p.rlike("^(BAT|PPG_LOGIC|EDA).*GND$"))).select(F.lit("HUMAN_GROUND_ON_LAB"), "name")
    return repeated.union(lost).union(ground)


def report_counts(violations: DataFrame, unconnected: DataFrame, by: str = "board") -> DataFrame:
    """Violations, unconnected items and the nets they leave open, of each board; description names the net."""
    a = violations.groupBy(by).agg(F.count("*").alias("violations"))
    b = unconnected.groupBy(by).agg(F.count("*").alias("unconnected"), F.countDistinct(net_of(F.col("description"))).alias("nets"))
    b = b.withColumnRenamed(by, "_by")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("violations", "unconnected", "nets")}
    return a.join(b, F.col(by).eqNullSafe(F.col("_by")), "full").withColumn(by, F.coalesce(by, "_by")).drop("_by").withColumns(counts)


def gate_summary(checks: DataFrame) -> DataFrame:
    """All checks (name, passed) as one verdict."""
    return checks.agg(F.count("*").alias("checks"), F.sum((~F.col("passed")).cast("long")).alias("failed"), F.bool_and("passed").alias("all_passed"))
