"""Presets and precedence; rows that stand in for none."""

import pytest

from tidemark.plans.parameters import RunParameters, resolved
from tidemark.sources import readers


def test_precedence():
    assert resolved() == RunParameters()
    assert resolved("arv", quick=True).window == 80 and resolved("arv", quick=True).frames == 60
    assert resolved("dense-agents", agents=7, grid=0).agents == 7 and resolved(grid=0).grid == 0
    assert resolved("coherence", seed=9).seed == 9 and resolved("quick", frames=1).frames == 1
    with pytest.raises(ValueError, match="unknown"):
        resolved("loud")


def test_zero_rows_stand_in(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", 1.5)], "t string, em_rf double").selectExpr("to_timestamp(t) ts", "em_rf")
    assert readers.or_null_rows(df, ["em_rf"]).count() == 1
    got = readers.or_null_rows(df.where("em_rf > 9"), ["em_rf"]).orderBy("ts").collect()
    assert len(got) == 10 and {r["em_rf"] for r in got} == {0.0} and (got[1]["ts"] - got[0]["ts"]).seconds == 60
