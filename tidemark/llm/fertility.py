"""Quality rules from tokeniser fertility, with rejection bands for each language or script.

Public vocabularies cut the words of a text into tokens: code points of words for each token (of two vocabularies),
the share of byte-fallback tokens, and the entropy of the token distribution as a share of the most that so many
tokens can have, less what a line through all documents of the language leads to expect at the logarithm of the length.
Over all documents, each language (the `lang` column; where that is missing or null the dominant script of the text) has
a band for each measure: the median plus and minus `width` robust deviations (the distance between the quartiles over
1.349, at least a floor), wider by sqrt(1 + short / n) for a text of n words, as a mean over few words strays further.  A
document outside a band is rejected.  The rule is the same at every size of table and of language; a language with
a single document lies in its own band.

The base rule rejects texts of fewer than 10 words, and those where words in repeated five-word windows are over 20 %.
Medians come from a mergeable sketch over all rows, the lines from sums; the table of bands has a row for each language or script.

Edge cases: a null text has no words and fails the base rule, as do empty and blank ones; repeated rows are judged
each for itself and count twice in the bands; measures on the edge of a band are inside; further columns are ignored; an empty table gives an empty result; long
texts are measured whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grams, hash_words, slices, stash
from tidemark.llm.wordtokens import entropy, piece_bpe, word_bpe

MEASURES = ("chars_per_piece", "chars_per_token", "byte_share", "entropy_share")
#: Least robust deviation of each measure, so that a language of nearly equal documents keeps a band.
FLOORS = (0.02, 0.02, 0.005, 0.01)
#: Tables of bands of up to this many languages are broadcast (about 200 bytes each).
BROADCAST_GROUPS = 100_000
_SPACE = bytes([32, *range(9, 14)])
_SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_TWO_BYTE_LEADS = ((0xC3, 0xC9, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD4, "cyrillic"), (0xD6, 0xD7, "hebrew"), (0xD8, 0xDD, "arabic"))


def script_of(text: bytes) -> str:
    """Dominant script by the lead bytes of letters."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by = {name: int(n[a : b + 1].sum()) for a, b, name in _TWO_BYTE_LEADS}
    by["latin"] += int(n[65:91].sum() + n[97:123].sum())
    by["other"] = int(n[0xE0:0xF5].sum())
    return max(by, key=by.get)


def repeated_words(five: np.ndarray, n_words: int) -> int:
    """Words inside five-word windows that stand at least twice."""
    if len(five) < 2:
        return 0
    _, which, many = np.unique(five, return_inverse=True, return_counts=True)
    edges = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(many[which] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return int((np.cumsum(edges)[:n_words] > 0).sum())


def measured(docs: DataFrame, piece_file: str, word_file: str) -> DataFrame:
    """doc_id, group (language or script), the base counts and the measures of each whole text."""
    source = docs.select("doc_id", F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = piece_bpe(piece_file), word_bpe(word_file)
        for batch, texts in slices(batches):
            parts = [t.split() for t in texts]
            hashes, counts, starts = hash_words(parts)
            every, rows = grams(hashes, 5), []
            for text, words, lang, n, s in zip(texts, parts, batch.column(1).to_pylist(), counts.tolist(), starts.tolist(), strict=True):
                chars = sum(map(len, words)) - (0 if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum()))
                seen: set[bytes] = set()
                dup = 0
                for line in text.split(b"\n"):
                    if line in seen:
                        dup += bool(line.split())
                    seen.add(line)
                ids, other = pieces(words), tokens.of_words(words)
                share = float(pieces.is_byte[ids].mean()) if len(ids) else 0.0
                most = np.log2(len(ids)) if len(ids) > 1 else 1.0
                rows.append((n, chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated_words(every[s : s + n - 4] if n >= 5 else every[:0], n), lang or script_of(text), chars / max(1, len(ids)), chars / max(1, len(other)), share, entropy(ids) / most))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(x.split()[0] for x in BASE.split(", ")), "group", *MEASURES])

    return source.mapInArrow(measure, f"doc_id long, {BASE}, `group` string, " + ", ".join(f"{m} double" for m in MEASURES))


def judged(docs: DataFrame, piece_file: str, word_file: str, width: float = 4.0, short: int = 200) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, band_group, the measures, and outside: the first measure that rejects, or null."""
    rows = stash(measured(docs, piece_file, word_file), "fertility")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    usable, length = rows.where(~failed), F.log2("n_words")
    lines = stash(usable.groupBy("group").agg(F.regr_slope("entropy_share", length).alias("slope"), F.avg("entropy_share").alias("mean"), F.avg(length).alias("middle")), "lines")
    few = lines.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda df: df)

    def off_line(part: DataFrame) -> DataFrame:
        expected = F.col("mean") + F.coalesce("slope", F.lit(0.0)) * (length - F.col("middle"))
        return part.join(small(lines), "group", "left").withColumn("off_line", F.col("entropy_share") - expected).drop("slope", "mean", "middle")

    names = [*MEASURES[:3], "off_line"]
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(f"q_{m}") for m in names]
    bands = stash(off_line(usable).groupBy("group").agg(*quartiles), "bands")
    full = off_line(rows).join(small(bands), "group", "left")
    wider, outside = width * F.sqrt(1 + short / F.greatest("n_words", F.lit(1))), F.lit(None).cast("string")
    for m, floor in reversed(list(zip(names, FLOORS, strict=True))):
        q = F.col(f"q_{m}")
        away = F.abs(F.col(m) - q[1]) > wider * F.greatest((q[2] - q[0]) / 1.349, F.lit(floor))
        outside = F.when(away, m).otherwise(outside)
    counts = [x.split()[0] for x in BASE.split(", ")]
    full = full.withColumn("outside", F.when(~F.col("base_failed"), outside))
    return full.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.col("outside").isNull()).alias("kept"), F.col("group").alias("band_group"), *MEASURES, "outside")
