"""Queries on plan requests as they come in as lines of JSON, and on what is answered."""

import uuid

from pyspark.sql import functions as F

from hushframe.operators import requests
from hushframe.plans.inputs import table
from hushframe.sources.staging import shared_folder
from hushframe.streaming import sink

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: By part a request of one of eleven kinds (the first six broken), four goals, and one of eight answers of a planner.
_GOAL = """CASE WHEN p_partkey % 11 = 1 THEN '' WHEN p_partkey % 11 = 5 THEN repeat('g', 501) WHEN p_partkey % 4 = 0 THEN 'Download my certificate' WHEN p_partkey % 4 = 1 THEN 'search'
           WHEN p_partkey % 4 = 2 THEN 'pick the region please' ELSE 'nothing here fits' END"""
_ANSWERS = [
    None,
    '{"action": "CLICK", "target_id": "el_1", "confidence": 0.7, "reason_code": "sure"}',
    '```json\n{"action": "WAIT"}\n```',
    "I would click el_0",
    '{"action": "DRAG", "target_id": "el_0"}',
    '{"action": "CLICK", "target_id": "el_9", "confidence": 0.9}',
    '{"action": "CLICK", "target_id": "el_0", "confidence": 2}',
    '{"action": "SCROLL", "target_id": "", "value": "down", "confidence": 0.25}',
]
_ANSWER = "CASE p_size % 8 " + " ".join(f"WHEN {k} THEN {'NULL' if a is None else repr(a)}" for k, a in enumerate(_ANSWERS)) + " END"
_RULES = """CASE p_partkey % 4 WHEN 0 THEN {'action': 'CLICK', 'target_id': 'el_0', 'value': '-', 'confidence': 0.95, 'reason_code': 'goal terms match disclosed control'}
  WHEN 1 THEN {'action': 'TYPE', 'target_id': 'el_1', 'value': '', 'confidence': 0.95, 'reason_code': 'goal names disclosed text field'}
  WHEN 2 THEN {'action': 'SELECT', 'target_id': 'el_2', 'value': 'north', 'confidence': 0.9, 'reason_code': 'goal names disclosed selection'}
  ELSE {'action': 'STOP', 'target_id': '-', 'value': '-', 'confidence': 0.3, 'reason_code': 'no disclosed element matches goal'} END"""
_STOP = "{{'action': 'STOP', 'target_id': '-', 'value': '-', 'confidence': 0.0, 'reason_code': '{0}'}}"
_SAID = f"""CASE p_size % 8 WHEN 1 THEN {{'action': 'CLICK', 'target_id': 'el_1', 'value': '-', 'confidence': 0.7, 'reason_code': 'sure'}}
  WHEN 2 THEN {{'action': 'WAIT', 'target_id': '-', 'value': '-', 'confidence': 0.5, 'reason_code': 'unspecified'}} WHEN 3 THEN {_STOP.format('planner schema failure: JSONDecodeError')}
  WHEN 5 THEN {_STOP.format('planner targeted undisclosed element')} WHEN 7 THEN {{'action': 'SCROLL', 'target_id': '', 'value': 'down', 'confidence': 0.25, 'reason_code': 'unspecified'}}
  ELSE {_STOP.format('planner schema failure: ValidationError')} END"""
_CODE = "CASE WHEN p_partkey % 11 IN (0, 1, 3, 4, 5) THEN 422 WHEN p_partkey % 11 = 2 THEN 413 END"


def _lines(spark, d):
    """Lines of JSON, one for each part."""
    k = F.col("p_partkey")
    e = lambda i, role, label, options: F.struct(
        F.concat(F.lit("el_"), i.cast("string")).alias("id"), role.alias("role"), F.lit(label).alias("label"), F.array(F.lit(1), F.lit(2)).alias("rect"),
        F.lit(False).alias("sensitive"), F.lit(True).alias("same_origin"), options.alias("options"),
    )
    none = F.lit(None).cast("array<string>")
    three = F.array(
        e(F.lit(0), F.lit("button"), "Download certificate", none),
        e(F.lit(1), F.when(k % 11 != 4, "textbox"), "Search", none),
        e(F.lit(2), F.lit("combobox"), "Pick region", F.array(F.lit("north"), F.lit("south"))),
    )
    many = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: e(i, F.lit("link"), "more", none))
    request = F.struct(
        k.alias("request_id"), F.expr(_GOAL).alias("goal"), F.when(k % 11 == 2, many).otherwise(three).alias("safe_metadata"),
        F.when(k % 11 == 3, "no base64!").alias("visual_context"), F.expr(_ANSWER).alias("answer"),
    )
    line = F.to_json(request)
    return table(spark, d, "part").select(k, F.when(k % 11 == 0, F.concat(F.substring(line, 1, 25), F.lit(" ...cut"))).otherwise(line).alias("value"))


@query(f"""WITH r AS (SELECT p_partkey, p_size, {_CODE} AS code, CASE WHEN p_size % 8 = 0 THEN 'rules' ELSE 'planner' END AS source, CASE WHEN p_size % 8 = 0 THEN {_RULES} ELSE {_SAID} END AS a FROM part)
   SELECT p_partkey AS request_id, 0 AS code, source, a.action AS action, a.target_id AS target_id, a.value AS value, CAST(a.confidence AS DOUBLE) AS confidence, a.reason_code AS reason_code FROM r WHERE code IS NULL
   UNION ALL SELECT CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey END, code, '-', '-', '-', '-', -1.0, '-' FROM r WHERE code IS NOT NULL""")
def stream_requests(spark, d):
    """Requests as a stream of files of JSON lines: what is answered, and by what, and what is rejected and why."""
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    lines = _lines(spark, d)
    for k in range(3):
        lines.where(F.col("p_partkey") % 3 == k).select("value").write.mode("append").text(folder)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    response = requests.RESPONSE[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    schemas = {"responses": f"request_id long, source string, {response}", "rejects": "request_id long, code int, line string"}
    out = sink.each_batch(requests.parsed(stream), "stream_requests", requests.split, schemas)
    none = lambda c: F.coalesce(c, F.lit("-"))
    fine = out["responses"].select("request_id", F.lit(0).alias("code"), "source", "action", none("target_id").alias("target_id"), none("value").alias("value"), "confidence", "reason_code")
    bad = out["rejects"].select(F.coalesce("request_id", F.lit(-1)).alias("request_id"), "code", *(F.lit("-").alias(c) for c in ("source", "action", "target_id", "value")), F.lit(-1.0).alias("confidence"), F.lit("-").alias("reason_code"))
    return fine.unionByName(bad)
