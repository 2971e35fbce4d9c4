"""Spans in steps against the same as single expressions, and the time that long texts take."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushframe.functions import runs, spans, text


def mixed(seed, n, longest):
    rng = random.Random(seed)
    parts = ["a.b@example.org", "né", " ", "30123456789012", "ABCDE1234F", "2345 6789 0123", "+91 9876543210", "9876543210", "12/05/1999", "HDFC0ABC123", "x", "é~_", "\n", "@", "4785380592391139a@b.org"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(longest))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("run", [runs.RUN, 2])
def test_steps_equal_expressions(spark, monkeypatch, run):
    monkeypatch.setattr(runs, "RUN", run)
    rows = mixed(1, 150, 25)
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string")
    t = F.col("text")
    want = {r.k: (r.s, r.c) for r in df.select("k", text.detect_spans(t).alias("s"), text.redact(t, text.detect_spans(t)).alias("c")).collect()}
    step = spans.redacted(spans.with_spans(df, "text", "s"), "text", "c")
    assert step.columns == ["k", "text", "s", "c"]
    for r in step.collect():
        assert (r.s or [], r.c) == (want[r.k][0] or [], want[r.k][1]), rows[r.k]


def test_twenty_thousand_matches_in_one_text(spark):
    n = 20_000
    whole = " ".join(f"é user{k}@example.org ABCDE{k % 10000:04d}F" for k in range(n // 2))
    df = spark.createDataFrame([(whole,), ("x",)], "text string")
    began = time.time()
    got = spans.redacted(spans.with_spans(df, "text", "s"), "text", "c").select(F.size("s").alias("n"), "c").collect()
    assert time.time() - began < 60
    assert sorted(r.n for r in got) == [0, n]
    assert max((r.c for r in got), key=len) == " ".join("é [EMAIL_1] [PAN_1]" for _ in range(n // 2))
