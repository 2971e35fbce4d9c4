import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions import geometry as g
from hushframe.functions import pixels
from hushframe.functions.bind import computed
from hushframe.operators import context, folds, layers, metrics, planner, snapshot, spatial
from hushframe.operators.text_rows import detect_rows, redacted
from hushframe.plans import page_queries
from hushframe.sources import corpus, pages

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
ELEMENT = f"page_id string, ord int, tag string, role string, box {BOX}, text string, label string, input_type string, enabled boolean, same_origin boolean"


def elements(spark, rows):
    full = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7] if len(r) > 7 else None, True, True) for r in rows]
    return spark.createDataFrame(full, ELEMENT)


def test_suppression_at_the_threshold(spark):
    # Two boxes of 100 x 10 whose overlap over union is exactly 0.45 are too close; just under is not.
    items = [(0.9, 1, "a", (0, 0, 29, 10)), (0.8, 2, "a", (11, 0, 40, 10)), (0.7, 3, "b", (12, 0, 41, 10))]
    df = spark.createDataFrame([(items,)], f"items array<struct<score:double,ord:int,cls:string,box:{BOX}>>")
    assert 18 / 40 == 0.45
    kept = df.select(folds.suppress(F.col("items")).alias("k"), folds.suppress(F.col("items"), per_class=True).alias("c")).first()
    assert [x.ord for x in kept.k] == [1, 3]
    assert [x.ord for x in kept.c] == [1, 3]


def test_plan_deduplication_prefers_important_classes(spark):
    rows = [("p", 1, (0, 0, 10, 10), "EMAIL", "token", "L1", "s", None), ("p", 2, (0, 0, 10, 10), "PAN", "blackout", "L3", "s", None), ("p", 3, (50, 0, 60, 10), "EMAIL", "token", "L1", "s", None)]
    plan = spark.createDataFrame(rows, f"page_id string, ord int, box {BOX}, cls string, mode string, layer string, src string, span string")
    assert [(r.cls, r.ord) for r in layers.deduplicated(plan).orderBy("place").collect()] == [("PAN", 2), ("EMAIL", 3)]


def test_first_fit_and_best_overlap_use_each_once(spark):
    gold = [(1, "A", 0, 5), (2, "A", 4, 9)]
    found = [(7, "A", 3, 6), (8, "B", 4, 9)]
    s = "array<struct<ord:int,cls:string,start:int,end:int>>"
    df = spark.createDataFrame([(gold, found)], f"g {s}, p {s}")
    assert df.select(folds.first_fit(F.col("g"), F.col("p")).alias("x")).first().x == [7, -1]
    boxes = spark.createDataFrame(
        [([(0.5, 1, "A", (0, 0, 10, 10)), (0.9, 2, "A", (0, 0, 10, 9))], [(1, "A", (0, 0, 10, 10)), (2, "A", (0, 0, 10, 8))])],
        f"p array<struct<score:double,ord:int,cls:string,box:{BOX}>>, g array<struct<ord:int,cls:string,box:{BOX}>>",
    )
    assert boxes.select(folds.best_overlap(F.col("p"), F.col("g")).alias("x")).first().x == [1, 2]


def test_phrase_box(spark):
    words = [("Name:", (0, 0, 30, 10)), ("Ravi", (40, 0, 60, 10)), ("Verma", (65, 0, 90, 12))]
    df = spark.createDataFrame([(words,)], f"w array<struct<text:string,box:{BOX}>>")
    got = df.select(folds.phrase_box(F.col("w"), F.lit("Ravi Verma")).alias("a"), folds.phrase_box(F.col("w"), F.lit("??")).alias("b")).first()
    assert tuple(got.a) == (37, -3, 93, 15) and got.b is None


def test_layers_of_a_page(spark):
    e = elements(spark, [
        ("p", 1, "div", "text", (0, 0, 100, 20), "ABCDE1234F", "PAN"),
        ("p", 2, "input", "textbox", (0, 30, 100, 50), "", "Login", "password"),
        ("p", 3, "img", "image", (200, 0, 300, 100), "", "Profile picture"),
        ("p", 4, "p", "text", (0, 60, 300, 90), "This was issued to Ravi Verma yesterday", ""),
    ])
    got = {(r.cls, r["mode"], r.layer) for r in layers.build_plan(e).collect()}
    assert got == {("PAN", "blackout", "L1"), ("PASSWORD", "blackout", "L1"), ("PERSON", "token", "L2")}
    browser = {(r.cls, r["mode"]) for r in layers.build_plan(e, profile="browser").collect()}
    assert ("IMAGE_REGION", "blur") in browser
    selective = {r.cls for r in layers.build_plan(e, e.limit(0).withColumn("cls", F.lit("")).withColumn("ocr_text", F.lit("")), selective=True).collect()}
    assert "PHOTO" in selective


def test_selective_layer_looks_only_where_structure_is_blind(spark):
    e = elements(spark, [("p", 1, "div", "text", (0, 0, 100, 20), "shown", "")])
    dets = spark.createDataFrame(
        [("p", 1, "value_chip", (0, 0, 100, 20), "a@b.org"), ("p", 2, "value_chip", (0, 200, 100, 220), "c@d.org"), ("p", 3, "image_region", (300, 0, 500, 200), ""), ("p", 4, "value_chip", (310, 10, 400, 30), "x")],
        f"page_id string, ord int, cls string, box {BOX}, ocr_text string",
    )
    plan = layers.visual_selective(dets, e, layers.structured(e))
    assert [(r.ord, r.cls) for r in plan.collect()] == [(2, "EMAIL")]


def test_context_and_disclosure(spark):
    e = elements(spark, [
        ("p", 1, "button", "button", (100, 100, 260, 140), "", "Download Certificate"),
        ("p", 2, "button", "button", (700, 600, 760, 640), "", "Print"),
        ("p", 3, "a", "link", (800, 650, 900, 680), "", "Help"),
        ("p", 4, "div", "text", (110, 150, 250, 170), "Ready since Monday", ""),
    ])
    none = e.limit(0)
    dets = none.select("page_id", "ord", "box", F.lit(0.5).alias("score"))
    ask = lambda goal: context.selected_context(context.scored_regions(e, spark.createDataFrame([("p", goal)], "page_id string, goal string"), dets, none), F.lit(1000), F.lit(700))
    got = ask("Download my income certificate")
    row = got.first()
    assert (row["mode"], row.selected_ids) == ("task-roi", [1, 4])
    assert tuple(row.crop) == (76, 76, 284, 194)
    assert [r.label for r in context.safe_metadata(e, none, got).collect()] == ["Download Certificate"]
    masks = e.where("ord = 1").select("page_id", "box")
    assert [r.label for r in context.safe_metadata(e, masks, got).collect()] == ["[REDACTED]"]
    empty = ask("renew passport").first()
    assert (empty["mode"], empty.kept, empty.pixel_fraction) == ("minimal-empty", 0, 1 / 700000)


def test_rules_planner(spark):
    requests = spark.createDataFrame([(1, "Download income certificate"), (2, "Sing"), (3, "enter otp"), (4, "x")], "request_id int, goal string")
    e = spark.createDataFrame(
        [(1, 1, "el_1", "link", "Download Certificate", False, True, None), (1, 2, "el_2", "button", "Print", False, True, None), (2, 1, "el_1", "button", "Print", True, True, None), (3, 1, "el_9", "textbox", "OTP field", False, True, None)],
        "request_id int, ord int, id string, role string, label string, sensitive boolean, same_origin boolean, options array<string>",
    )
    got = {r.request_id: (r.action, r.target_id, r.confidence) for r in planner.plan_rules(requests, e).collect()}
    assert got == {1: ("CLICK", "el_1", 0.82), 2: ("STOP", None, 0.3), 3: ("TYPE", "el_9", 0.5), 4: ("STOP", None, 0.3)}


def test_request_errors_and_endpoint(spark):
    df = spark.createDataFrame([(1, None), (101, None), (1, "???"), (1, "aGVsbG8="), (1, "iVBORw0KGgoAAAA=")], "n int, v string")
    assert [r.x for r in df.select(planner.request_error(F.col("n"), F.col("v")).alias("x")).collect()] == [None, 413, 422, 422, None]
    urls = spark.createDataFrame([("http://127.0.0.1:8000/plan",), ("https://127.0.0.1:8000/plan",), ("http://127.0.0.1.evil.org:8000/plan",), (None,)], "u string")
    assert [r.x for r in urls.select(planner.allowed_endpoint(F.col("u")).alias("x")).collect()] == [True, False, False, False]


def test_stale_and_verified(spark):
    t = "struct<role:string,label:string,same_origin:boolean,enabled:boolean>"
    df = spark.createDataFrame([(("button", "Download", True, True), ("button", "Download now", True, True)), (("button", "Download", True, True), None), (("button", "Download", True, True), ("link", "Download", True, True)), (("button", "Download", True, True), ("button", "Print", True, True)), (("button", "Download", True, True), ("button", "Download", False, True)), (("button", "Download", True, True), ("button", "Download", True, False))], f"a {t}, b {t}")
    assert [r.x for r in df.select(planner.stale_reason(F.col("a"), F.col("b")).alias("x")).collect()] == [None, "no element at target point", "target role changed", "target label changed", "target origin changed", "target is disabled"]
    s = "struct<url:string,title:string,height:int,scroll_y:int,text_length:int>"
    v = spark.createDataFrame([(("u", "t", 1, 0, 100), ("u", "t", 1, 0, 105), 0), (("u", "t", 1, 0, 100), ("u", "t", 1, 0, 106), 0), (("u", "t", 1, 0, 100), ("u", "t", 1, 0, 100), 1)], f"a {s}, b {s}, n int")
    assert [r.x for r in v.select(planner.verified(F.col("a"), F.col("b"), F.col("n")).alias("x")).collect()] == [False, True, True]


def test_snapshot_fields(spark):
    s = lambda v: F.lit(v).cast("string")
    row = spark.range(1).select(
        snapshot.role_of(s(None), s("input"), s("checkbox")).alias("a"), snapshot.role_of(s(" tab "), s("a"), s(None)).alias("b"), snapshot.role_of(s(""), s("select"), s(None)).alias("c"),
        snapshot.label_of(s(" "), s(None), s("  two\n words ")).alias("d"),
        snapshot.input_type(s("text"), s("one-time-code"), s(""), s(None), s(None)).alias("e"),
        snapshot.same_origin(s("/x"), s("https://a.org/y")).alias("f"), snapshot.same_origin(s("https://A.org/z"), s("https://a.org/y")).alias("g"),
        snapshot.same_origin(s("javascript:void(0)"), s("https://a.org/y")).alias("h"), snapshot.same_origin(s("https://b.org"), s("https://a.org/y")).alias("i"),
    ).first()
    assert tuple(row) == ("checkbox", "tab", "combobox", "two words", "otp", True, True, False, False)


def test_point_and_agreement(spark):
    e = elements(spark, [("p", 1, "div", "text", (0, 0, 100, 100), "", ""), ("p", 2, "div", "text", (10, 10, 50, 50), "", "")])
    points = spark.createDataFrame([("p", 20.0, 20.0), ("p", 90.0, 90.0), ("p", 500.0, 5.0)], "page_id string, x double, y double")
    assert {(r.x, r.hit) for r in spatial.at_point(points, e).collect()} == {(20.0, 2), (90.0, 1), (500.0, None)}


def test_latency_rule_and_empty_denominators(spark):
    df = spark.createDataFrame([("c", f"p{i % 3}", i, float(i)) for i in range(1, 49)], "config string, page string, k int, ms double")
    row = metrics.latency(df, "config", "page", ["k"], "ms").first()
    assert (row.n, row.median, row.p95) == (48, 24.5, 45.0)
    zero = metrics.prf(spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")).first()
    assert (zero.precision, zero.recall, zero.f1) == (0.0, 0.0, 0.0)


def test_target_visible(spark):
    df = spark.createDataFrame([((0, 0, 10, 10), [(0, 0, 5, 10)]), ((0, 0, 10, 10), [(0, 0, 6, 10), (0, 0, 6, 10)])], f"t {BOX}, m array<{BOX}>")
    assert [r.x for r in df.select(metrics.target_visible(F.col("t"), F.col("m")).alias("x")).collect()] == [True, False]


def test_text_pages_and_detector(spark):
    made = corpus.text_pages(spark, 6)
    assert sorted(r.level for r in made.select("level").collect()) == [1, 1, 2, 2, 3, 3]
    assert all(r.html[x.start : x.end] == x.text for r in made.collect() for x in r.gold)
    page = spark.createDataFrame([("p", "<td class='label'>PAN</td><td class='value'>ABCDE1234F</td><td class='label'>Aadhaar</td><td class='value'>2345 6789 0123</td><input type='password'> a@b.org")], "page_id string, html string")
    row = redacted(detect_rows(page)).first()
    assert [(x.cls, x.text) for x in row.entities] == [("PAN", "ABCDE1234F"), ("EMAIL", "a@b.org")]
    assert row.clean.endswith("[PASSWORD_FIELD] [EMAIL_1]") and "[PAN_1]" in row.clean


def test_snapshot_files_and_upsert(spark, tmp_path):
    (tmp_path / "test_a.dom.json").write_text('{"width": 1280, "height": 720, "elements": [{"tag": "div", "rect": [1, 2, 3, 4], "text": "x"}]}')
    e = pages.elements(pages.snapshots(spark, str(tmp_path))).collect()
    assert [(r.page_id, r.ord, tuple(r.box), r.label) for r in e] == [("test_a", 0, (1, 2, 3, 4), None)]
    (tmp_path / "test_b.dom.json").write_text('{"width": 10, "elements": []}')
    (tmp_path / "test_a.gt.json").write_text('{"family": "hr", "split": "dev", "elements": [{"cls": "PAN", "box": [1, 2, 3, 4], "pii": "PAN", "text": "x"}]}')
    both = {r.page_id: r.truth for r in pages.with_truths(spark, str(tmp_path)).collect()}
    assert both["test_b"] is None and both["test_a"].family == "hr" and both["test_a"].elements[0].cls == "PAN"
    new = lambda v: spark.createDataFrame([("a", v)], "k string, v int")
    pages.write_results(new(1), str(tmp_path / "one"))
    assert pages.upsert_results(new(2), str(tmp_path / "table"), ["k"]).collect() == [("a", 2)]
    assert pages.upsert_results(new(3), str(tmp_path / "table"), ["k"]).collect() == [("a", 3)]


def test_undisclosed_targets_stop(spark):
    from hushframe.operators import planner

    actions = spark.createDataFrame(
        [(1, "CLICK", "el_1", 0.8, "a"), (1, "CLICK", "el_9", 0.8, "a"), (2, "SCROLL", None, 0.5, "b"), (2, "WAIT", "", 0.4, "c")],
        "request_id int, action string, target_id string, confidence double, reason_code string",
    )
    elements = spark.createDataFrame([(1, "el_1"), (1, "el_1"), (2, "el_9")], "request_id int, id string")
    got = {tuple(r) for r in planner.undisclosed_to_stop(actions, elements).collect()}
    assert got == {
        (1, "CLICK", "el_1", 0.8, "a"), (1, "STOP", None, 0.0, planner.UNDISCLOSED), (2, "SCROLL", None, 0.5, "b"), (2, "WAIT", "", 0.4, "c"),
    }


def test_a_phrase_is_found_in_lines_of_many_words_in_time(spark):
    """Each word is looked at once, not once for each window that it lies in and each side of the box."""
    rows = spark.range(2_000)
    word = lambda k: F.when(k == 299, "RAVI").when(k == 300, "Verma,").otherwise(F.concat(F.lit("lorem"), (k + F.col("id")).cast("string")))
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.struct(word(k).alias("text"), F.struct(k.alias("x1"), F.lit(0).alias("y1"), (k + 1).alias("x2"), F.lit(10).alias("y2")).alias("box")))
    found = computed(computed(rows, "w", words), "f", folds.phrase_box(F.col("w"), F.lit("Ravi Verma")))
    begin = time.time()
    assert {tuple(r) for r in found.select("f.x1", "f.x2").collect()} == {(296, 303)}
    assert time.time() - begin < 20
    none = spark.sql("SELECT array(named_struct('text', CAST(NULL AS STRING), 'box', named_struct('x1', 0, 'y1', 0, 'x2', 1, 'y2', 1))) AS w")
    assert none.select(folds.phrase_box(F.col("w"), F.lit("Ravi Verma")).alias("f")).collect()[0]["f"] is None
    assert none.select(folds.phrase_box(F.slice("w", 1, 0), F.lit("Ravi Verma")).alias("f")).collect()[0]["f"] is None


def test_a_union_of_few_boxes_is_that_of_their_pixels(spark):
    """One, two, many apart, many that meet, empty and inverted ones, and more than are compared in pairs."""
    rng = random.Random(5)
    box = lambda side: (x := rng.randrange(40), y := rng.randrange(40), x + rng.randrange(-2, side), y + rng.randrange(-2, side))
    cases = [[box(side) for _ in range(n)] for n in (0, 1, 2, 3, 4, 7, 16, 17, 40) for side in (3, 20) for _ in range(4)]
    cases.append([(0, 0, 60_000, 60_000), (70_000, 0, 130_000, 60_000)])
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, b array<{BOX}>")
    pixels = lambda c: len({(x, y) for x1, y1, x2, y2 in c for x in range(x1, x2) for y in range(y1, y2)})
    got = {r.k: r.px for r in df.select("k", g.union_area(F.col("b")).alias("px")).collect()}
    assert got == {k: pixels(c) for k, c in enumerate(cases[:-1])} | {len(cases) - 1: 2 * 3_600_000_000}


def test_pixels_of_pages_are_counted_a_batch_at_once(spark):
    """one Arrow function a batch, no fold over each page's slabs; the same figures as that fold, nulls too."""
    rng = random.Random(8)
    box = lambda side: (x := rng.randrange(-5, 40), y := rng.randrange(-5, 40), x + rng.randrange(-2, side), y + rng.randrange(-2, side))
    rows = [(k, [box(side) for _ in range(n)], [box(side) for _ in range(m)]) for k, (n, m, side) in enumerate(itertools.product((0, 1, 2, 5, 30), (0, 1, 3, 17), (3, 20, 60)))]
    rows += [(900, None, [box(20)]), (901, [box(20)], None), (902, [None, box(20), (1, 2, None, 9)], [(None, None, 7, 7), None])]
    pages = spark.createDataFrame(rows, f"k int, masks array<{BOX}>, sensitive array<{BOX}>")
    got = metrics.masked_pixels(pages, 32, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_sort" not in plan, plan
    on_page = lambda c: F.transform(c, lambda b: g.clipped(b, 32, 30))
    folded = pages.select("k", on_page("masks").alias("a"), on_page("sensitive").alias("b"))
    folded = folded.select("k", g.union_area(F.col("a")), g.union_area(F.col("b")), g.union_area(F.concat("a", "b")))
    want = {r[0]: (*r[1:], None if None in r[1:] else r[1] + r[2] - r[3]) for r in map(tuple, folded.collect())}
    assert {r.k: (r.mask_px, r.sensitive_px, r.either_px, r.both_px) for r in got.collect()} == want
    assert got.columns == ["k", "mask_px", "sensitive_px", "either_px", "both_px"]


def test_pixels_of_a_large_page_are_counted_in_parts():
    """however few pairs of slab and box are held at once, and where areas are beyond 32 bits."""
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 4, 300))
    x, y = rng.integers(0, 50, 300), rng.integers(0, 50, 300)
    boxes = np.stack([x, y, x + rng.integers(-1, 30, 300), y + rng.integers(-1, 30, 300)]).clip(0, 60)
    lit = [np.zeros((60, 60), bool) for _ in range(5)]
    for r, (x1, y1, x2, y2) in zip(rows, boxes.T):
        lit[r][x1:x2, y1:y2] = True
    want = [int(p.sum()) for p in lit]
    for pairs in (1, 7, 500, pixels.PAIRS):
        assert pixels.union_areas(5, rows, boxes, 60, 60, pairs).tolist() == want
    wide = np.array([[0, 0, 60_000, 60_000], [70_000, 0, 130_000, 60_000]]).T
    assert pixels.union_areas(1, np.zeros(2, int), wide, 130_000, 60_000).tolist() == [2 * 3_600_000_000]


def _evaluations(df, name):
    """How many operators of the plan name an expression."""
    return sum(name in line for line in df._jdf.queryExecution().optimizedPlan().treeString().split("\n"))


def test_words_of_an_element_are_one_array_and_texts_are_classified_once(spark):
    """no join of spans with words one by one, and neither phrases nor classes looked for twice a row."""
    e = elements(spark, [("p", 1, "div", "text", (0, 0, 400, 20), "Handed to Ravi Verma and then to Asha Nair today", "")])
    words = spark.createDataFrame([("p", k, t, (10 * k, 5, 10 * k + 8, 15), 1) for k, t in enumerate("Handed to Ravi Verma and then to Asha Nair today".split())], f"page_id string, ord int, text string, box {BOX}, element int")
    plan = layers.build_plan(e, None, layers=("L1", "L2"))
    found = layers.found_items(e, None, layers=("L1", "L2"))
    small = layers.narrowed(found, words)
    assert {(r.span, tuple(r.box), r.narrowed) for r in small.collect()} == {("Ravi Verma", (17, 2, 41, 18), True), ("Asha Nair", (67, 2, 81, 18), True)}
    assert [r.span for r in plan.collect()] == ["Ravi Verma"]
    assert _evaluations(small, "[^A-Za-z0-9]") <= 2
    assert _evaluations(layers.structured(e), "GRV") == 1


def test_a_selection_is_made_once_a_page(spark):
    """a filter on what is selected must not make the selection a second time."""
    e = elements(spark, [("p", 1, "button", "button", (100, 100, 260, 140), "", "Download Certificate")])
    none = e.limit(0)
    scored = context.scored_regions(e, spark.createDataFrame([("p", "Download certificate")], "page_id string, goal string"), none.select("page_id", "ord", "box", F.lit(0.5).alias("score")), none)
    chosen = context.selected_context(scored, F.lit(1000), F.lit(700))
    assert _evaluations(context.safe_metadata(e, none, chosen), ".direct") == 1


@pytest.mark.parametrize("name", ["selective_plan", "layer_ablation"])
def test_a_plan_deals_its_boxes_out_once(spark, name):
    """lines were dealt out for each read, and again for each join by page and box: the disk filled."""
    plan = page_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(l_orderkey" in line for line in dealt)
    # All are one: they have the same columns.
    assert len({tuple(sorted(set(re.findall(r"l_[a-z]+", line)))) for line in plan.splitlines() if "FileScan" in line}) == 1


@pytest.mark.parametrize("selective", [True, False])
def test_a_page_at_once_finds_what_joins_of_its_rows_find(spark, selective):
    rng = random.Random(5)
    texts = ["ABCDE1234F", "Handed to Ravi Verma and then to Asha Nair today", "", None, "ravi@example.org"]
    at = lambda: (lambda x, y: (x, y, x + rng.choice([40, 60]), y + rng.choice([20, 40])))(rng.choice([0, 1, 20]), rng.choice([0, 20]))
    es = [(p, k, rng.choice(["img", "div"]), rng.choice(["image", "text"]), at(), rng.choice(texts), rng.choice(["photo of the applicant", "Name", None]), rng.choice([None, None, "password"])) for p in range(25) for k in range(6) if p != 3]
    ds = [(p, k, at(), rng.choice(["image_region", "value_chip", "button"]), rng.choice(texts)) for p in range(30) for k in range(5) if p != 4]
    box = "box struct<x1:int,y1:int,x2:int,y2:int>"
    e = spark.createDataFrame(es, f"page_id int, ord int, tag string, role string, {box}, text string, label string, input_type string")
    d = spark.createDataFrame(ds, f"page_id int, ord int, {box}, cls string, ocr_text string")
    for on in (("L1", "L2", "L3"), ("L2", "L3"), ("L3",), ("L1", "L2")):
        want = layers.deduplicated(layers.found_items(e, d, layers=on, selective=selective))
        got = layers.build_plan(e, d, layers=on, selective=selective)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())), on
        assert got.count() > 10
