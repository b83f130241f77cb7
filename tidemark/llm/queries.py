"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, compact_windows, decontaminate, fertility, html_extract, line_dedup, minhash, packing, pii, quality, ranked, secret_scan, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A file of the public tokenizers; TIDEMARK_TOKENIZERS names another folder."""
    import public_tokenizers

    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), tokenizer("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.line_decisions(docs)
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"))
    out = every.join(gone.withColumnRenamed("doc_id", "id"), (F.col("doc_id").eqNullSafe(F.col("id"))) & (every["text_hash"] == gone["text_hash"]), "left")
    removed = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit())
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans", "n_added")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_extract.extract(pages, html_extract.fit(pages))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"), secret_scan.fit())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_candidates", "n_added", "n_doubtful")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fertility, op2_line_dedup, op3_quality, op4_pii, op5_suffix_dedup, op6_html, op7_compact_windows, op8_decontamination, op9_best_fit_packing, op10_minhash, op11_ranked, op12_centroids, op13_secrets, pipeline)}


#: Lines by (doc_id, position); equal lines keep the first; near lines by all pairs that share eight code points at an end.
OP2 = r"""
WITH l AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
  ) WHERE regexp_matches(line, '[^ \t\r\f\v]')
), u AS (
  SELECT line, min(struct_pack(d := doc_id, n := n)) AS first, length(line) AS len FROM l GROUP BY line
), f AS (SELECT * FROM u WHERE len >= 16), p AS (
  SELECT a.line AS early, b.line AS late FROM f a JOIN f b ON left(a.line, 8) = left(b.line, 8) AND a.first < b.first AND abs(a.len - b.len) <= 1
  UNION
  SELECT a.line AS early, b.line AS late FROM f a JOIN f b ON right(a.line, 8) = right(b.line, 8) AND a.first < b.first AND abs(a.len - b.len) <= 1
), near AS (SELECT DISTINCT late FROM p WHERE levenshtein(early, late) <= 1),
gone AS (
  SELECT l.doc_id, count(*) AS n_removed, string_agg(CAST(l.n AS VARCHAR), ',' ORDER BY l.n) AS removed
  FROM l JOIN u USING (line) LEFT JOIN near ON near.late = l.line
  WHERE near.late IS NOT NULL OR struct_pack(d := l.doc_id, n := l.n) > u.first GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, coalesce(g.removed, '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id)
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, z GROUP BY w, docs),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
u AS (SELECT q, item_id, unnest(w) AS w FROM i),
s AS (
  SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM u JOIN f USING (w) JOIN p USING (w) JOIN l USING (r), z GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """Each round as two common table expressions: nearest centroids, and the floor of their means."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "p AS MATERIALIZED (SELECT r, vec_id, unnest(range(64)) AS d, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v)",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM f JOIN p USING (r))",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min(struct_pack(dist := dist, c := c)) AS b FROM (SELECT r, c, sum((p.x - q.x) * (p.x - q.x)) AS dist FROM p JOIN c{t} q USING (d) GROUP BY ALL) GROUP BY r)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT a.b.c AS c, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM p JOIN a{t} a USING (r) GROUP BY ALL)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, d, coalesce(m.x, q.x) AS x FROM c{t} q LEFT JOIN m{t} m USING (c, d))")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f""",
o AS (SELECT r, CAST({last}.b.c AS INTEGER) AS cluster, CAST({last}.b.dist AS BIGINT) AS distance FROM {last}),
h AS (SELECT CAST(c AS INTEGER) AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM o JOIN v USING (r) JOIN h USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op11_ranked": OP11, "op12_centroids": _op12()}
