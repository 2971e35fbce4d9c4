"""Ranks without sorting a group, templates, narrowing, ablations, and scores of a loop, on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import folds, layers, loop, metrics

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def rank_key(x):
    return (math.isnan(x), 0 if math.isnan(x) else x)


@pytest.mark.parametrize("buckets", [metrics.RANK_BUCKETS, 64])
def test_values_at_ranks(spark, monkeypatch, buckets):
    monkeypatch.setattr(metrics, "RANK_BUCKETS", buckets)
    rng = random.Random(7)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(500)],
        "skewed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(200)],
        "odd": [float("nan"), float("inf"), float("-inf"), 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, 5e-324] * 3,
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(101)],
        "one": [4.5],
        "nan": [float("nan")] * 3,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    ranks = {"low": F.lit(1), "q": F.greatest(F.lit(1).cast("bigint"), F.floor(n / 4)), "mid": F.floor((n + 1) / 2), "top": n}
    got = {r.g: r for r in metrics.at_ranks(df, "g", "v", ranks).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs, r = sorted(vs, key=rank_key), got[g]
        want = [vs[0], vs[max(1, len(vs) // 4) - 1], vs[(len(vs) + 1) // 2 - 1], vs[-1]]
        assert r.n == len(vs) and [repr(x + 0.0) for x in (r.low, r.q, r.mid, r.top)] == [repr(x + 0.0) for x in want], g


def naive_fill(templates, values):
    lines, used = [], []
    for text, slots in templates:
        if set(used) != set(values) and all(s in values for s in slots) and any(s not in used for s in slots):
            for s in slots:
                text = text.replace("{" + s + "}", values[s])
            lines.append(text)
            used += [s for s in slots if s not in used]
    return lines, used, sorted(set(values) - set(used))


def test_templates_cover_values_greedily(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(80):
        values = {s: f"{s.lower()}{{v}}$1\\" for s in "ABCDE" if rng.random() < 0.6}
        templates = []
        for _ in range(rng.randrange(6)):
            slots = rng.sample("ABCDE", rng.randrange(1, 4))
            templates.append((" ".join(f"{{{s}}}," for s in slots) + " end", slots))
        cases.append((templates, values))
    df = spark.createDataFrame([(k, [{"text": t, "slots": s} for t, s in ts], v) for k, (ts, v) in enumerate(cases)], "k long, t array<struct<text:string,slots:array<string>>>, v map<string,string>")
    for r in df.select("k", folds.filled_templates(F.col("t"), F.col("v")).alias("f")).collect():
        templates, values = cases[r.k]
        assert (r.f.lines, r.f.used, r.f.left) == naive_fill(templates, values)


def boxed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("box", F.col("box").cast(BOX))


PLAN = f"page_id long, ord int, box {BOX}, cls string, mode string, layer string, src string, span string, start int"
WORDS = f"page_id long, ord int, text string, box {BOX}"


def test_narrowing_takes_the_words_inside_and_leaves_the_rest(spark):
    plan = boxed(
        spark,
        [
            (1, 0, (0, 0, 200, 50), "PERSON", "token", "L2", "s", "Ravi Verma", 3),
            (1, 1, (300, 0, 400, 50), "PERSON", "token", "L2", "s", "Ravi Verma", 0),  # its words stand elsewhere
            (1, 2, (0, 0, 200, 50), "PAN", "blackout", "L1", "s", None, 0),
            (2, 0, (0, 0, 200, 50), "PERSON", "token", "L2", "s", "Ravi Verma", 0),  # no words on the page
        ],
        PLAN,
    )
    words = boxed(spark, [(1, 0, "Dear", (0, 10, 30, 20)), (1, 1, "ravi", (40, 10, 60, 20)), (1, 2, "VERMA.", (70, 12, 99, 22)), (1, 3, "Ravi", (250, 10, 280, 20))], WORDS)
    got = {(r.page_id, r.ord): (tuple(r.box), r.narrowed) for r in layers.narrowed(plan, words).collect()}
    assert got == {(1, 0): ((37, 7, 102, 25), True), (1, 1): ((300, 0, 400, 50), False), (1, 2): ((0, 0, 200, 50), False), (2, 0): ((0, 0, 200, 50), False)}


def test_an_ablation_gives_the_plans_of_each_configuration(spark):
    schema = f"page_id long, ord int, tag string, role string, box {BOX}, text string, label string, input_type string"
    text = "Handed to Ravi Verma and then to Asha Nair today"
    rows = [(p, k, "div", "text", (k * 50, p, k * 50 + 40 + p, 60), text if k % 2 else "ABCDE1234F", "PAN" if k % 2 == 0 else "", "password" if k == 4 else None) for p in (1, 2) for k in range(6)]
    e = boxed(spark, rows, schema)
    dets = boxed(spark, [(p, k, "value_chip", (k * 30, 0, k * 30 + 25, 90), "ravi@example.org") for p in (1, 2, 3) for k in range(4)], f"page_id long, ord int, cls string, box {BOX}, ocr_text string")
    words = e.where("text like 'Handed%'").select("page_id", F.col("ord").alias("element"), "box", F.posexplode(F.split("text", " ")).alias("ord", "text"))
    words = words.withColumn("box", F.struct(F.col("box.x1"), F.col("box.y1"), (F.col("box.x1") + 4).alias("x2"), (F.col("box.y1") + 4).alias("y2")))
    flat = lambda df: sorted((r.page_id, r.place, r.cls, r.layer, r.span, r.ord, tuple(r.box)) for r in df.collect())
    got = layers.ablation(e, dets, words)
    for config, (last, small) in layers.CONFIGS.items():
        on = [x for x in ("L1", "L2", "L3") if x <= last]
        want = layers.build_plan(e, dets, layers=on, words=words if small else None)
        key = lambda rows: sorted(rows, key=repr)
        assert key([(r.page_id, r.place, r.cls, r.layer, r.span, r.ord, tuple(r.box)) for r in got.where(F.col("config") == config).collect()]) == key(
            [(r.page_id, r.place, r.cls, r.layer, r.span, r.ord, tuple(r.box)) for r in want.collect()]
        ), config


def test_loop_scores(spark):
    schema = f"page_id long, ord int, role string, text string, label string, input_type string, box {BOX}"
    e = boxed(
        spark,
        [
            (1, 0, "text", "Ravi Verma", "", None, (0, 0, 10, 10)),
            (1, 1, "button", "Download form", "", None, (20, 0, 30, 10)),
            (1, 2, "textbox", "", "Asha Nair", None, (40, 0, 50, 10)),  # a label that gives a name away
            (2, 0, "button", "Download form", None, None, (0, 0, 10, 10)),  # masked
            (2, 1, "link", "Help", None, None, (20, 0, 30, 10)),
            (2, 2, "textbox", "", "Secret", "password", (40, 0, 50, 10)),
            (3, 0, "button", "Print", None, None, (0, 0, 10, 10)),  # no target
        ],
        schema,
    )
    plan = boxed(spark, [(2, (0, 0, 8, 10)), (2, (20, 0, 25, 10))], f"page_id long, box {BOX}")
    pages = loop.disclosures(e, plan)
    rows = {r.page_id: r for r in pages.collect()}
    assert [rows[k].target for k in (1, 2, 3)] == ["el_1", "el_0", None] and rows[1].goal == "Download form for me"
    assert {k: [m.id for m in r.safe_metadata] for k, r in rows.items()} == {1: ["el_1", "el_2"], 2: ["el_1"], 3: ["el_0"]}
    gold = spark.createDataFrame([(1, "Ravi Verma"), (1, "Asha Nair"), (1, "Asha Nair"), (1, ""), (1, None), (2, "Secret")], "page_id long, text string")
    scored = loop.loop_scores(pages.withColumn("set", F.lit("a")).withColumn("secrets_found", F.lit(1)).withColumn("secrets_expected", F.lit(2)), gold, "set").collect()
    assert scored == [("a", 3, 1 / 3, 2, 3, 6)]


def test_overmasking_counts_what_is_not_sensitive(spark):
    df = spark.createDataFrame([(1, "a", [(0, 0, 10, 10)], [(5, 0, 10, 10)]), (2, "a", [], [(0, 0, 5, 5)]), (3, "b", [], [])], f"page_id long, set string, masks array<{BOX}>, sensitive array<{BOX}>")
    got = {r.set: (r.over_px, r.overmask_pct) for r in loop.overmasked(df, "set", 20, 10).collect()}
    assert got == {"a": (50, 12.5), "b": (0, 0.0)}


def test_values_of_templates_are_made_once(spark):
    values = F.map_from_entries(F.array(F.struct(F.lit("A").alias("s"), F.col("id").cast("string").alias("v"))))
    templates = F.array(F.struct(F.concat(F.lit("is {A} "), F.col("id").cast("string")).alias("text"), F.array(F.lit("A")).alias("slots")))
    df = spark.range(2).select(folds.filled_templates(templates, values).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("map_from_entries") == 1
    assert [tuple(r.f) for r in df.collect()] == [(["is 0 0"], ["A"], []), (["is 1 1"], ["A"], [])]
