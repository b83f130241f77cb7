"""Line dedup by a deletion-neighbourhood join.

A line of a text goes if an earlier line of the corpus is equal to it or, for lines of at least `min_chars` code points,
within one edit (insertion, deletion or substitution of one code point).  Earlier means smaller (doc_id, hash of
text, line number); a null doc_id comes first.  Blank lines always stay.

Two lines within one edit share their first or their last half, so lines are first halved twice by hashed halves,
and only lines that share a quarter-level key with a different line emit their deletion variants: the rest of the
line with each code point left out, and the rest itself.  Equal variants with the same gap differ by a
substitution; a variant equal to an untouched rest is an insertion or deletion.  The link from each line to the
earliest such line is then verified with the edit distance.  No pairs within a group are made: each group of equal
variants holds distinct lines only, at most (length + 1) times the alphabet, and keeps a minimum.

Edge cases: null texts have no lines; rows that repeat both doc_id and text are one document and share a decision;
further columns pass through, whatever their names; of equal lines the earliest stays; an empty table gives an empty result; long texts cost time linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stash

#: Lines shorter than this are not halved first: all of their variants are emitted.
HALVED = 16


def _occurrences(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.trim(F.regexp_replace("line", r"[\t\r\f\x0B]", " ")) != "")
    place = F.struct("doc_id", "text_hash", "line_no").alias("place")
    return lines.select(place, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _halves(rows: DataFrame, step: int) -> DataFrame:
    """Each row twice (rarely four times): keyed by its first half, with the rest after it, and by its last half.

    Half is floor(length / 2) rounded down to `step`; lengths that differ by one may round differently, so a line at
    the edge also takes the smaller half.
    """
    size = F.char_length("rest")
    half = F.floor(size / (2 * step)).cast("int") * step
    sizes = F.when((size % (2 * step) == 0) & (half >= step), F.array(half, half - step)).otherwise(F.array(half))
    cut = rows.withColumn("half", F.explode(sizes)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    first, last = F.expr("left(rest, half)"), F.expr("right(rest, half)")
    return cut.select(
        F.xxhash64("key", "side", "half", F.when(F.col("side") == 0, first).otherwise(last)).alias("key"),
        F.when(F.col("side") == 0, F.expr("substring(rest, half + 1)")).otherwise(F.expr("left(rest, char_length(rest) - half)")).alias("rest"),
        "place", "h1", "h2",
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key at least two different lines have, one row for each line and key."""
    keys = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    return rows.join(keys, "key").groupBy("key", "h1", "h2").agg(F.min("place").alias("place"), F.first("rest").alias("rest"))


def near_lines(occurrences: DataFrame, min_chars: int = 16) -> DataFrame:
    """Lines (h1, h2) with an earlier line within one edit, and the place of the earliest: columns h1, h2, earlier."""
    long = occurrences.where(F.char_length("line") >= min_chars)
    whole_lines = long.select(F.lit(0).cast("long").alias("key"), F.col("line").alias("rest"), "place", "h1", "h2")
    first = stash(_shared(_halves(whole_lines.where(F.char_length("rest") >= HALVED), 8)), "line-halves")
    rests = _shared(_halves(first, 2))
    if min_chars < HALVED:  # a short line may be near one that is just long enough to be halved
        short = whole_lines.where(F.char_length("rest") <= HALVED)
        rests = rests.unionByName(short.groupBy("key", "h1", "h2").agg(F.min("place").alias("place"), F.first("rest").alias("rest")).select(*rests.columns))
    rests = stash(rests, "line-rests")
    gap = F.explode(F.expr("sequence(-1, char_length(rest) - 1)"))
    variants = rests.withColumn("gap", gap).select(
        F.xxhash64("key", F.when(F.col("gap") < 0, F.col("rest")).otherwise(F.expr("concat(left(rest, gap), substring(rest, gap + 2))"))).alias("variant"),
        "key", "gap", "h1", "h2", "place",
    )
    group, gaps = Window.partitionBy("variant"), Window.partitionBy("variant", "gap")
    whole = F.col("gap") < 0
    best = variants.select(
        "key", "h1", "h2", "place",
        F.least(
            F.when(whole, F.min("place").over(group)).otherwise(F.min(F.when(whole, F.col("place"))).over(group)),
            F.when(~whole, F.min("place").over(gaps)),
        ).alias("earlier"),
    ).where("earlier < place").distinct()
    there = rests.select("key", F.col("place").alias("earlier"), F.col("rest").alias("other"))
    verified = best.join(rests.select("key", "place", "rest"), ["key", "place"]).join(there, ["key", "earlier"])
    verified = verified.where(F.levenshtein("rest", "other", 1) >= 0)
    return verified.groupBy("h1", "h2").agg(F.min("earlier").alias("earlier"))


def line_decisions(docs: DataFrame, min_chars: int = 16) -> DataFrame:
    """Lines that go, for each document that loses any: doc_id, text_hash, removed (sorted line numbers from 0)."""
    every = _occurrences(docs)
    near = near_lines(every, min_chars).select("h1", "h2", F.lit(True).alias("near"))
    bare = every.select("place", "h1", "h2")
    # Most lines are unique: only those that occur again or are near another are carried on.
    lines = bare.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    lines = lines.join(near, ["h1", "h2"], "left").where("near or first <> last").drop("last")
    gone = bare.join(lines, ["h1", "h2"]).where("near or place > first").select("place.*").distinct()
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        out = []
        for text, removed in zip(batch.column(at["text"]).to_pylist(), batch.column(at["_cut_lines"]).to_pylist(), strict=True):
            gone = set(removed or ())
            out.append(text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
        names = [n for n in batch.schema.names if n != "_cut_lines"]
        columns = [pa.array(out, pa.string()) if n == "text" else batch.column(at[n]) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(at["_cut_lines"])], [*names, "_cut_lines"])


def dedup_lines(docs: DataFrame, min_chars: int = 16) -> DataFrame:
    """docs with the repeated lines cut out of text; documents of which no line is left go."""
    gone = line_decisions(docs, min_chars).select(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash"), F.col("removed").alias("_cut_lines"))
    names = docs.columns
    docs = docs.toDF(*[f"_in_{i}" if n in gone.columns else n for i, n in enumerate(names)])  # columns of the input may have our names
    matched = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_cut_id")) & (F.xxhash64(docs["text"]) == F.col("_cut_hash")), "left").drop("_cut_id", "_cut_hash")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matched.schema)
    kept = matched.mapInArrow(_cut, schema)
    return kept.where("_cut_lines is null or text rlike '[^\\\\s]'").drop("_cut_lines").toDF(*names)
