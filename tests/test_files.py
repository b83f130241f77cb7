"""Framed logs, release documents and checksums: round trips, damage and failing tasks."""

import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checksum
from tidemark.sources import framed, release


def plain_crc32c(data):
    s = 0xFFFFFFFF
    for b in data:
        s ^= b
        for _ in range(8):
            s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(1)
    data = [b"", b"a", b"abc", b"abcd", b"123456789", *(rng.randbytes(n) for n in (63, 64, 65, 127, 128, 129, 1000))]
    assert checksum.crc32c_of(data).tolist() == [plain_crc32c(d) for d in data]
    assert checksum.crc32c_of([b"123456789"])[0] == 0xE3069283 and len(checksum.crc32c_of([])) == 0


def encoded(payloads):
    return framed.frame_of(pd.Series(range(len(payloads))), pd.Series(payloads, dtype=object)).tolist()


def prefix(spark, path, **options):
    rows = framed.recovered(framed.read_log(spark, path, **options)).orderBy("offset").collect()
    return [(r["sequence"], bytes(r["payload"])) for r in rows]


@pytest.fixture(scope="module")
def frames():
    rng = random.Random(3)
    inner = encoded([b"inner one", b"", b"inner three"])
    payloads = [rng.randbytes(rng.randint(0, 90)) for _ in range(60)]
    payloads[5], payloads[6], payloads[20] = b"".join(inner), framed.MAGIC * 9, framed.MAGIC[:3] + framed.MAGIC + b"\x01\x00\x00\x00"
    payloads[30] = b"x" * 10 + inner[2]  # an inner frame that ends with its frame
    return payloads, encoded(payloads)


@pytest.mark.parametrize("split", [97, 10**6])
def test_damage_at_any_split(spark, tmp_path, frames, split):
    payloads, raw = frames
    whole, ends, rng = b"".join(raw), np.cumsum([len(r) for r in raw]), random.Random(split)
    logs = {"whole": whole, "empty": b""}
    for k in range(4):
        logs[f"cut{k}"] = whole[: rng.randint(1, len(whole) - 1)]
        at = rng.randrange(len(whole))
        logs[f"flip{k}"] = whole[:at] + bytes([whole[at] ^ 0x41]) + whole[at + 1 :]
    logs["first"] = b"\x00" + whole[1:]
    logs["gap"] = whole[: ends[9]] + b"junk" + whole[ends[9] :]
    for name, data in logs.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    got = framed.recovered(framed.read_log(spark, str(tmp_path), splitbytes=split)).select(F.regexp_extract("path", r"(\w+)\.log$", 1).alias("log"), "sequence", "payload").collect()
    for name, data in logs.items():
        same = next((i for i, (a, b) in enumerate(zip(data, whole, strict=False)) if a != b), min(len(data), len(whole)))
        want = [(i, p) for i, p in enumerate(payloads) if ends[i] <= same]
        assert sorted((r["sequence"], bytes(r["payload"])) for r in got if r["log"] == name) == want, name


def test_frames_after_damage_are_still_read(spark, tmp_path, frames):
    payloads, raw = frames
    data = bytearray(b"".join(raw))
    data[len(raw[0]) + 2] ^= 1
    (tmp_path / "a.log").write_bytes(bytes(data))
    got = framed.read_log(spark, str(tmp_path)).select("sequence").collect()
    assert sorted(r[0] for r in got) == [0, *range(2, 60)] and len(prefix(spark, str(tmp_path))) == 1


def test_write_and_read(spark, tmp_path):
    rows = [("a", i, f"payload {i}") for i in range(50)] + [("b", 7, None), ("b", 3, "x")]
    df = spark.createDataFrame(rows, "log string, sequence long, payload string").repartition(4)
    path = f"file://{tmp_path}/logs"
    framed.write_log(df.withColumn("frame", framed.frame("sequence", "payload")), path)
    got = framed.recovered(framed.read_log(spark, path, splitbytes=100)).select(F.regexp_extract("path", r"/(\w)\.[^/]*$", 1), "sequence", F.col("payload").cast("string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, c or "") for a, b, c in rows)


def test_a_failing_task_leaves_no_log(spark, tmp_path):
    bad = spark.range(8, numPartitions=4).select(F.lit("a").alias("log"), F.when(F.col("id") == 6, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"z")).alias("frame"))
    spark.dataSource.register(framed.FramedLog)
    with pytest.raises(Exception, match="stop"):
        bad.write.format("framed_log").mode("append").save(str(tmp_path / "logs"))
    assert list((tmp_path / "logs").glob("*")) == []  # the folder alone


def test_manifest(spark, tmp_path):
    rows = [(f"f{i}", f"{zlib.crc32(b'x' * i):08x}", i) for i in range(20)] + [("null", None, None)]
    df = spark.createDataFrame(rows, "path string, sha256 string, size_bytes long").repartition(3)
    path = f"file://{tmp_path}/manifest.json"
    release.write_manifest(df, path, {"release_version": "1"})
    doc = json.loads((tmp_path / "manifest.json").read_text())
    assert doc["verified"] and doc["sections"] == {"files": 21} and doc["release_version"] == "1"
    got = release.read_section(spark, path, "files", "path string, sha256 string, size_bytes long").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    part = tmp_path / doc["parts"][0]["part"]
    part.write_text(part.read_text().replace("f", "g", 1))
    with pytest.raises(ValueError, match="digests"):
        release.read_section(spark, path, "files", "path string")


def test_summary_and_failing_task(spark, tmp_path):
    steps = spark.createDataFrame([("a", 0), ("b", 0)], "command string, exit_code int")
    files = spark.createDataFrame([("p", "d")], "path string, sha256 string")
    none = spark.createDataFrame([], "path string")
    release.write_summary(steps, files, none, str(tmp_path / "ok.json"))
    assert release.document(str(tmp_path / "ok.json"))["verified"]
    release.write_summary(steps, files, spark.createDataFrame([("todo.md",)], "path string"), str(tmp_path / "left.json"))
    assert not release.document(str(tmp_path / "left.json"))["verified"]
    release.write_summary(steps.union(steps.selectExpr("command", "exit_code + 1")), files, none, str(tmp_path / "bad.json"))
    assert not release.document(str(tmp_path / "bad.json"))["verified"]
    before = sorted(p.name for p in tmp_path.iterdir())
    wrong = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 6, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.lit("f")).alias("path"))
    with pytest.raises(Exception, match="stop"):
        release.write_manifest(wrong, str(tmp_path / "never.json"))
    assert sorted(p.name for p in tmp_path.iterdir()) == before
