"""Checks of schema documents against what a release expects of them.

A document of any depth is read as VARIANT and flattened level by level to rows of paths; lists are put together again
by their parents, and all rules are joins and comparisons of such rows.  Many documents are checked at once.

Edge cases: a null text or one that is no JSON has no object at its root, and that is its only error; of two
conditionals for one value the later counts; a list that is expected as strings and holds other things differs from
it; an empty table has no errors; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The draft that documents name, and the fields whose values choose a conditional (fixed values).
DRAFT = "https://json-schema.org/draft/2020-12/schema"
DISCRIMINANTS = ("provenance", "record_type")


@dataclass(frozen=True)
class Expected:
    """What a document must hold: required root fields, enumerations by definition, properties, and required fields by (discriminant, value)."""

    required: Sequence[str]
    enumerations: Mapping[str, Sequence[str]]
    properties: Sequence[str]
    conditionals: Mapping[tuple[str, str], Sequence[str]]


def paths(docs: DataFrame, by: str, text: str) -> DataFrame:
    """by, parent, path, key, pos, kind and value of every node; kind is OBJECT, ARRAY or the scalar's type."""
    spark = docs.sparkSession
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    none = F.lit(None).cast("string")
    level = docs.select(F.col(by).alias("_id"), none.alias("parent"), F.lit("$").alias("path"), none.alias("key"), F.lit(None).cast("int").alias("pos"), F.try_parse_json(text).alias("v")).withColumn("kind", kind(F.col("v")))
    found = level
    while True:
        level = level.where("kind in ('OBJECT', 'ARRAY')")
        if level.isEmpty():
            break
        own = level.select("_id", F.col("path").alias("parent"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        level = own.select("_id", "parent", F.concat("parent", step).alias("path"), "key", F.when(F.col("key").isNull(), F.col("pos")).alias("pos"), F.col("value").alias("v")).withColumn("kind", kind(F.col("v")))
        found = found.union(level)
    return found.select(F.col("_id").alias(by), "parent", "path", "key", "pos", "kind", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string")).alias("value"))


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def errors(docs: DataFrame, by: str, text: str, expected: Expected) -> DataFrame:
    """by and error: each rule that a document breaks."""
    nodes = paths(docs, by, text)
    lists = nodes.where("pos is not null").groupBy(by, F.col("parent").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("kind") == "STRING", F.col("value")).alias("v")))), lambda x: x["v"]).alias("items"))
    empty = nodes.where("kind = 'ARRAY'").select(F.col(by).alias("_i"), F.col("path").alias("_p"))
    arrays = empty.join(lists, (F.col("_i").eqNullSafe(F.col(by))) & (F.col("_p") == F.col("path")), "left").select(F.col("_i").alias("id"), F.col("_p").alias("path"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    kinds, values, parents = {}, {}, {}
    at = lambda p, c: F.max(F.when(F.col("path") == p, F.col(c)))
    wanted = ["$", "$.$schema", "$.type", "$.additionalProperties", "$.$defs", "$.properties", "$.allOf"]
    facts = nodes.groupBy(F.col(by).alias("id")).agg(
        *[at(p, "kind").alias(f"k{i}") for i, p in enumerate(wanted)], *[at(p, "value").alias(f"v{i}") for i, p in enumerate(wanted)], F.collect_set(F.when(F.col("parent") == "$.properties", F.col("key"))).alias("properties")
    )
    kinds = {p: F.col(f"k{i}") for i, p in enumerate(wanted)}
    values = {p: F.col(f"v{i}") for i, p in enumerate(wanted)}
    held = {"required": "$.required"} | {f"enum_{n}": f"$.$defs.{n}.enum" for n in expected.enumerations}
    listed = arrays.groupBy(F.col("id").alias("_l")).agg(*[F.max(F.when(F.col("path") == p, F.col("items"))).alias(n) for n, p in held.items()])
    parents = facts.join(listed, F.col("id").eqNullSafe(F.col("_l")), "left")

    conditionals = _conditionals(nodes.withColumnRenamed(by, "id"), arrays)
    bad = conditionals.groupBy(F.col("id").alias("_b")).agg(F.max(F.col("invalid").cast("int")).alias("invalid"))
    latest = conditionals.where("not invalid").groupBy("id", "field", "constant").agg(F.max_by("then_required", "rule").alias("then_required"))
    keyed = latest.groupBy(F.col("id").alias("_c")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("=", "field", "constant"), "then_required"))).alias("rules"))
    full = parents.join(bad, F.col("id").eqNullSafe(F.col("_b")), "left").join(keyed, F.col("id").eqNullSafe(F.col("_c")), "left")
    rules = F.coalesce("rules", F.create_map().cast("map<string,array<string>>"))
    names = {f"{d}={c}": r for (d, c), r in expected.conditionals.items()}
    root = kinds["$"].eqNullSafe(F.lit("OBJECT"))
    invalid = ~kinds["$.allOf"].eqNullSafe(F.lit("ARRAY")) | (F.coalesce("invalid", F.lit(0)) == 1)
    broken = [
        (~root, "schema root must be an object"),
        (root & ~values["$.$schema"].eqNullSafe(F.lit(DRAFT)), "schema draft URI mismatch"),
        (root & ~values["$.type"].eqNullSafe(F.lit("object")), "schema root type must be object"),
        (root & ~(kinds["$.additionalProperties"].eqNullSafe(F.lit("BOOLEAN")) & values["$.additionalProperties"].eqNullSafe(F.lit("false"))), "schema root must set additionalProperties to false"),
        (root & ~F.col("required").eqNullSafe(_list(expected.required)), "schema root required fields mismatch"),
        (root & ~kinds["$.$defs"].eqNullSafe(F.lit("OBJECT")), "schema defs must be an object"),
        *[(root & kinds["$.$defs"].eqNullSafe(F.lit("OBJECT")) & ~F.col(f"enum_{n}").eqNullSafe(_list(v)), f"{n} enum mismatch") for n, v in expected.enumerations.items()],
        (root & ~kinds["$.properties"].eqNullSafe(F.lit("OBJECT")), "schema properties must be an object"),
        *[(root & kinds["$.properties"].eqNullSafe(F.lit("OBJECT")) & ~F.array_contains("properties", n), f"missing property definition for {n}") for n in expected.properties],
        (root & invalid, "conditional structure invalid"),
        (root & ~invalid & ~F.array_sort(F.map_keys(rules)).eqNullSafe(_list(sorted(names))), "conditional set mismatch"),
        *[(root & ~invalid & ~F.try_element_at(rules, F.lit(n)).eqNullSafe(_list(r)), f"conditional required mismatch for {n}") for n, r in names.items()],
    ]
    return full.select(F.col("id").alias(by), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in broken]))).alias("error"))


def _conditionals(nodes: DataFrame, arrays: DataFrame) -> DataFrame:
    """id, rule, field, constant, then_required and whether it is malformed, of the rules under allOf that name a discriminant."""
    rule = F.regexp_extract("path", r"^\$\.allOf\[(\d+)\](.*)$", 1)
    under = F.regexp_extract("path", r"^\$\.allOf\[(\d+)\](.*)$", 2)
    inside = nodes.where(F.col("path").startswith("$.allOf[")).select("id", rule.try_cast("int").alias("rule"), under.alias("rest"), "kind", "value")
    lists = arrays.where(F.col("path").startswith("$.allOf[")).select("id", rule.try_cast("int").alias("rule"), under.alias("rest"), "items")
    kind = lambda p: F.max(F.when(F.col("rest") == p, F.col("kind")))
    constant = {d: F.max(F.when((F.col("rest") == f".if.properties.{d}.const") & (F.col("kind") == "STRING"), F.col("value"))) for d in DISCRIMINANTS}
    rules = inside.where("rule is not null").groupBy("id", "rule").agg(kind(".if").alias("ki"), kind(".then").alias("kt"), kind(".if.properties").alias("kp"), *[c.alias(f"c_{d}") for d, c in constant.items()])
    given = lists.groupBy(F.col("id").alias("_i"), F.col("rule").alias("_r")).agg(F.max(F.when(F.col("rest") == ".if.required", F.col("items"))).alias("if_required"), F.max(F.when(F.col("rest") == ".then.required", F.col("items"))).alias("then_required"))
    both = rules.join(given, F.col("id").eqNullSafe(F.col("_i")) & (F.col("rule") == F.col("_r")), "left").where("ki = 'OBJECT' and kt = 'OBJECT' and kp = 'OBJECT'")
    field = F.coalesce(*[F.when(F.col(f"c_{d}").isNotNull(), F.lit(d)) for d in DISCRIMINANTS])
    named = both.select("id", "rule", field.alias("field"), F.coalesce(*[F.col(f"c_{d}") for d in DISCRIMINANTS]).alias("constant"), "if_required", "then_required").where("field is not null")
    return named.select("id", "rule", "field", "constant", "then_required", (~F.col("if_required").eqNullSafe(F.array("field")) | F.col("then_required").isNull()).alias("invalid"))
