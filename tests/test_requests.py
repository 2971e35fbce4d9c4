"""Requests and answers one by one; keyed tables that change at once, once."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators import requests
from hushframe.sources.versions import Conflict, KeyedTable

BUTTON = {"id": "el_0", "role": "button", "label": "Download certificate", "sensitive": False, "same_origin": True}
FINE = {"request_id": 1, "goal": "Download my certificate", "safe_metadata": [BUTTON]}


def split(spark, *lines):
    raw = spark.createDataFrame([(x if x is None or isinstance(x, str) else json.dumps(x),) for x in lines], "value string")
    return {k: v.collect() for k, v in requests.split(requests.parsed(raw)).items()}


@pytest.mark.parametrize(
    "line, code",
    [
        (FINE, None),
        ("", 422),
        ("not json", 422),
        (None, 422),
        ("[1, 2]", 422),
        ({**FINE, "goal": ""}, 422),
        ({**FINE, "goal": "x" * 500}, None),
        ({**FINE, "goal": "x" * 501}, 422),
        ({"request_id": 1, "safe_metadata": []}, 422),
        ({**FINE, "safe_metadata": None}, None),
        ({**FINE, "safe_metadata": [BUTTON] * 100}, None),
        ({**FINE, "safe_metadata": [BUTTON] * 101}, 413),
        ({**FINE, "safe_metadata": [{"id": "a"}]}, 422),
        ({**FINE, "safe_metadata": [{**BUTTON, "rect": "left"}]}, 422),
        ({**FINE, "visual_context": "###"}, 422),
        ({**FINE, "visual_context": "aGVsbG8="}, 422),
        ({**FINE, "visual_context": "iVBORw0KGgoAAAA="}, None),
        ({**FINE, "more": 1}, None),
    ],
)
def test_what_is_rejected(spark, line, code):
    out = split(spark, line)
    assert ([r.code for r in out["rejects"]], len(out["responses"])) == (([], 1) if code is None else ([code], 0))


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, ("CLICK", "el_0", None, 0.95, requests.CLICK)),
        ('{"action": "CLICK", "target_id": "el_0"}', ("CLICK", "el_0", None, 0.5, "unspecified")),
        ('```json\n{"action": "TYPE", "target_id": "el_0", "value": "x", "confidence": 1}\n```', ("TYPE", "el_0", "x", 1.0, "unspecified")),
        ("", ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "JSONDecodeError")),
        ("{", ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "JSONDecodeError")),
        ("[]", ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "ValidationError")),
        ('{"action": "JUMP"}', ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "ValidationError")),
        ('{"action": "WAIT", "confidence": 1.5}', ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "ValidationError")),
        ('{"action": "WAIT", "confidence": "sure"}', ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "ValidationError")),
        ('{"action": "WAIT", "reason_code": "%s"}' % ("r" * 161), ("STOP", None, None, 0.0, requests.SCHEMA_FAILURE + "ValidationError")),
        ('{"action": "CLICK", "target_id": "el_7"}', ("STOP", None, None, 0.0, "planner targeted undisclosed element")),
    ],
)
def test_what_is_answered(spark, answer, want):
    (r,) = split(spark, {**FINE, "answer": answer})["responses"]
    assert (r.action, r.target_id, r.value, r.confidence, r.reason_code) == want and r.source == ("rules" if answer is None else "planner")


def test_rules_take_the_first_of_the_best_and_skip_what_may_not_be_acted_on(spark):
    e = lambda i, **more: {**BUTTON, "id": f"el_{i}", **more}
    goal = {"request_id": 1, "goal": "download certificate"}
    cases = [
        ([e(0, sensitive=True), e(1, same_origin=False), e(2, role="text"), e(3, label=""), e(4), e(5)], "el_4"),
        ([e(0, role="textbox"), e(1)], "el_1"),
        ([e(0, label="something else"), e(1, role="combobox", options=["a", "b"])], "el_1"),
        ([e(0, label="download")], "el_0"),
        ([e(0, sensitive=None, same_origin=None)], "el_0"),
        ([], None),
    ]
    for elements, want in cases:
        (r,) = split(spark, {**goal, "safe_metadata": elements})["responses"]
        assert r.target_id == want, elements


def test_audit_keeps_no_text(spark):
    raw = spark.createDataFrame([(json.dumps({**FINE, "visual_context": "iVBORw0KGgoAAAA="}),)], "value string")
    (r,) = requests.audit(requests.parsed(raw)).collect()
    assert len(r.goal_hash) == 12 and r.elements == 1 and r.image_bytes == 11 and set(r.asDict()) == {"request_id", "goal_hash", "elements", "image_bytes"}


SCHEMA = "k string, at long, v long"


def rows(spark, *r):
    return spark.createDataFrame(r, SCHEMA)


def keyed(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "t"), rows(spark, ("", 0, 0)).schema, ["k"], buckets=4, **more)


def test_upserts_replace_by_key(spark, tmp_path):
    t = keyed(spark, tmp_path)
    assert t.read().count() == 0
    assert t.upsert(rows(spark, ("a", 1, 1), ("b", 1, 1), (None, 1, 1)))
    assert t.upsert(rows(spark, ("a", 0, 2), ("c", 1, 2), (None, 2, 2)))
    assert sorted(map(tuple, t.read().collect()), key=repr) == sorted([("a", 0, 2), ("b", 1, 1), ("c", 1, 2), (None, 2, 2)], key=repr)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    t = keyed(spark, tmp_path, order=["at"])
    assert t.upsert(rows(spark, ("a", 5, 1)), "s", 0) and t.upsert(rows(spark, ("b", 1, 1)), "s", 1)
    before = t.manifests.names()
    assert not t.upsert(rows(spark, ("a", 9, 9)), "s", 0) and not t.upsert(rows(spark, ("b", 9, 9)), "s", 1)
    assert t.manifests.names() == before and t.upsert(rows(spark, ("a", 4, 9)), "other", 0)
    assert sorted(map(tuple, t.read().collect())) == [("a", 5, 1), ("b", 1, 1)]


def test_a_write_that_fails_or_comes_second_changes_nothing(spark, tmp_path):
    t = keyed(spark, tmp_path)
    t.upsert(rows(spark, ("a", 1, 1)))
    broken = rows(spark, ("a", 2, 2)).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken)
    number, manifest = t._manifest()
    assert t.upsert(rows(spark, ("a", 3, 3)))
    with pytest.raises(Conflict):
        t._commit(number, manifest, {}, "", None)
    assert t.read().collect() == [("a", 3, 3)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = keyed(spark, tmp_path)
    t.upsert(rows(spark, *((f"k{i}", 0, 0) for i in range(40))))
    before = t._manifest()[1]["buckets"]
    t.upsert(rows(spark, ("k1", 1, 1)))
    after = t._manifest()[1]["buckets"]
    assert len(before) == 4 and sum(before[k] != after[k] for k in before) == 1 and t.read().count() == 40


def test_what_has_expired_goes_and_old_versions_are_cleared(spark, tmp_path):
    t = keyed(spark, tmp_path)
    t.upsert(rows(spark, *((f"k{i}", i, 0) for i in range(20))))
    assert t.remove(F.col("at") < 15) == 15 and t.remove(F.col("at") < 15) == 0
    assert sorted(r.at for r in t.read().collect()) == list(range(15, 20))
    assert t.remove(F.lit(True)) == 5 and t.read().count() == 0
    t.upsert(rows(spark, ("z", 1, 1)))
    t.vacuum(1)
    assert len(t.manifests.names()) == 1 and t.read().collect() == [("z", 1, 1)]
