"""Queries on the rest of a step: what is read from a page, what goes over the wire, what is checked around an action."""

from pyspark.sql import functions as F

from hushframe.functions.bind import computed
from hushframe.functions.geometry import area
from hushframe.operators import folds, metrics, planner, snapshot
from hushframe.plans.inputs import BOXES_SQL, boxes, cover, table

QUERIES, ORACLE_SQL = {}, {}
B = f"b AS ({BOXES_SQL})"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def choose(key, values):
    """The same choice in both engines: an expression over key modulo the number of values."""
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


TAG = choose("o_orderkey", ["input", "textarea", "button", "a", "img", "select", "div"])
KIND = choose("o_custkey", [None, "checkbox", "radio", "password", "text"])
GIVEN = choose("o_orderkey", [None, "", None, None, " tab ", None, None, None, None, None, None])
LABEL = choose("o_custkey", ["Enter OTP", "Name", "One-time code", "", "Login"])
MAXLENGTH = choose("o_orderkey", ["6", None, "4"])


@query(f"""WITH e AS (SELECT o_orderkey, {TAG} tag, {KIND} kind, trim(coalesce({GIVEN}, '')) given, {LABEL} label, {MAXLENGTH} ml FROM orders)
   SELECT o_orderkey, CASE WHEN given <> '' THEN given WHEN tag = 'input' THEN CASE WHEN kind IN ('checkbox', 'radio') THEN kind ELSE 'textbox' END
     WHEN tag = 'textarea' THEN 'textbox' WHEN tag = 'button' THEN 'button' WHEN tag = 'a' THEN 'link' WHEN tag = 'img' THEN 'image' WHEN tag = 'select' THEN 'combobox' ELSE 'text' END AS role,
     CASE WHEN kind = 'password' THEN 'password' WHEN contains(lower(label), 'otp') OR contains(lower(label), 'one-time') OR ml = '6' THEN 'otp' END AS input_type,
     CASE WHEN label <> '' THEN label ELSE tag END AS label FROM e""")
def element_fields(spark, d):
    """Roles, secret input types and labels from attributes."""
    e = table(spark, d, "orders").select("o_orderkey", *(F.expr(x).alias(n) for x, n in ((TAG, "tag"), (KIND, "kind"), (GIVEN, "given"), (LABEL, "label"), (MAXLENGTH, "ml"))))
    none = F.lit(None).cast("string")
    return e.select(
        "o_orderkey",
        snapshot.role_of(F.col("given"), F.col("tag"), F.col("kind")).alias("role"),
        snapshot.input_type(F.col("kind"), none, F.col("label"), F.lit("numeric"), F.col("ml")).alias("input_type"),
        snapshot.label_of(F.col("label"), none, F.col("tag")).alias("label"),
    )


@query(f"""WITH {B} SELECT page_id, ord FROM b WHERE x2 - x1 >= 6 AND y2 - y1 >= 6 AND y2 >= 0 AND y1 <= 500 AND x2 >= 0 AND x1 <= 800 AND cls <> 'PERSON'""")
def visible_elements(spark, d):
    b = boxes(spark, d).withColumn("visibility", F.when(F.col("cls") == "PERSON", "hidden"))
    none = F.lit(None).cast("string")
    return b.where(snapshot.visible(F.col("box"), F.lit(800), F.lit(500), F.col("visibility"), none, none)).select("page_id", "ord")


@query(f"""WITH {B} SELECT page_id, max(CASE WHEN contains(label, 'Certificate') AND side = 'O' THEN 1 ELSE 0 END) AS leaked,
      CAST(count_if(contains(label, 'Certificate') AND side = 'O') AS BIGINT) AS n FROM b GROUP BY page_id""")
def leak_check(spark, d):
    """Whether a page's metadata, as JSON without nulls, holds a string that should have been hidden."""
    b = boxes(spark, d).where("side = 'O'").select("page_id", F.to_json(F.struct("ord", "role", "label", F.lit(None).cast("string").alias("value"))).alias("wire"))
    hit = F.contains("wire", F.lit("Certificate")).cast("int")
    per = b.groupBy("page_id").agg(F.max(hit).alias("leaked"), F.sum(hit.cast("bigint")).alias("n"))
    return boxes(spark, d).select("page_id").distinct().join(per, "page_id", "left").fillna(0)


@query(r"""SELECT conv_id, turn, CAST(octet_length(encode('{"role":"' || role || '","turn":' || turn || '}')) AS BIGINT) AS bytes FROM conversations""")
def payload_bytes(spark, d):
    """Size of a request body; null fields are left out."""
    body = F.to_json(F.struct("role", "turn", F.lit(None).cast("string").alias("value")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.octet_length(body).cast("bigint").alias("bytes"))


URL = choose("o_orderkey", ["http://127.0.0.1:8000/plan", "http://localhost:8000/plan", "https://localhost:8000/plan", "http://localhost:8001/plan", "http://example.org:8000/plan", "http://localhost:8000/plan/x"])


@query(f"SELECT o_orderkey, {URL} IN ('http://127.0.0.1:8000/plan', 'http://localhost:8000/plan') AS ok FROM orders")
def endpoint_whitelist(spark, d):
    return table(spark, d, "orders").select("o_orderkey", planner.allowed_endpoint(F.expr(URL)).alias("ok"))


IMAGE = choose("o_custkey", [None, "", "???", "aGVsbG8=", "iVBORw0KGgoAAAA="])


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 150 > 100 THEN 413 WHEN {IMAGE} IN ('???', 'aGVsbG8=') THEN 422 ELSE 0 END AS code FROM orders")
def request_limits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(planner.request_error(F.col("o_orderkey") % 150, F.expr(IMAGE)), F.lit(0)).alias("code"))


WAS, IS = choose("o_orderkey", ["Download", "Print", "", "Help me"]), choose("o_custkey", ["Download now", "print", "Help", "Send"])


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'no element at target point' WHEN o_custkey % 11 = 0 THEN 'target is disabled' WHEN o_custkey % 7 = 0 THEN 'target role changed'
     WHEN {WAS} <> '' AND NOT (contains(lower({IS}), lower({WAS})) OR contains(lower({WAS}), lower({IS}))) THEN 'target label changed'
     WHEN o_custkey % 5 = 0 THEN 'target origin changed' ELSE '' END AS reason FROM orders""")
def stale_targets(spark, d):
    c = F.col("o_custkey")
    expected = F.struct(F.lit("button").alias("role"), F.expr(WAS).alias("label"), F.lit(True).alias("same_origin"))
    probe = F.struct(F.when(c % 7 == 0, "link").otherwise("button").alias("role"), F.expr(IS).alias("label"), (c % 5 != 0).alias("same_origin"), (c % 11 != 0).alias("enabled"))
    reason = planner.stale_reason(expected, F.when(c % 13 != 0, probe))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(reason, F.lit("")).alias("reason"))


@query("""SELECT o_orderkey, (o_custkey % 9 = 0) OR (o_custkey % 4 = 0) OR (o_orderkey % 8 > 5) AS ok FROM orders""")
def post_action_check(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    page = lambda title, n: F.struct(F.lit("u").alias("url"), title.alias("title"), F.lit(1).alias("height"), F.lit(0).alias("scroll_y"), n.alias("text_length"))
    after = page(F.when(c % 4 == 0, "new").otherwise("old"), F.lit(100) + k % 8)
    return table(spark, d, "orders").select("o_orderkey", planner.verified(page(F.lit("old"), F.lit(100)), after, (c % 9 == 0).cast("int")).alias("ok"))


@query(f"""WITH {B}, t AS (SELECT page_id, x1, y1, x2, y2 FROM b WHERE ord = 1), m AS (SELECT page_id, x1, y1, x2, y2 FROM b WHERE ord = 2)
   SELECT t.page_id, m.page_id IS NULL OR {cover('t', 'm')} <= 0.5 AS visible FROM t LEFT JOIN m ON m.page_id = t.page_id""")
def target_visibility(spark, d):
    b = boxes(spark, d)
    t = b.where("ord = 1").select("page_id", F.col("box").alias("t")).join(b.where("ord = 2").groupBy("page_id").agg(F.collect_list("box").alias("m")), "page_id", "left")
    masks = F.coalesce("m", F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))
    return t.select("page_id", metrics.target_visible(F.col("t"), masks).alias("visible"))


@query(f"""WITH {B}, c AS (SELECT role AS cls, CAST(count_if(side = 'O') AS DOUBLE) / count(*) AS recall FROM b GROUP BY role) SELECT cls, recall FROM c ORDER BY recall, cls LIMIT 3""")
def weakest_classes(spark, d):
    scores = metrics.prf(boxes(spark, d).groupBy(F.col("role").alias("cls")).agg(F.count_if(F.col("side") == "O").alias("tp"), F.lit(0).alias("fp"), F.count_if(F.col("side") != "O").alias("fn")))
    return metrics.weakest(scores.select("cls", "recall"))


@query("SELECT max(value) AS peak_mb, avg(CAST(event_id % 100 AS DOUBLE)) AS cpu_ms, avg(CAST(user_id % 4 AS DOUBLE)) AS ocr_per_page FROM events")
def resource_summary(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("rss_mb"), (F.col("event_id") % 100).cast("double").alias("cpu_ms"), (F.col("user_id") % 4).cast("double").alias("ocr_calls"))
    return metrics.summary(e)


@query("""WITH c AS (SELECT c_custkey, c_custkey % 20 + 1 AS k FROM customer WHERE c_custkey % 3 <> 0)
   SELECT c_custkey, CAST(k * 50 - 3 AS INT) AS x1, CAST(k * 50 + CASE WHEN k <= 4 THEN 93 ELSE 43 END AS INT) AS x2 FROM c""")
def phrase_windows(spark, d):
    """A two-word phrase among twenty-three words of a line, at a place that the key gives; a third of rows lack it."""
    i = F.sequence(F.lit(1), F.lit(23))
    at = (F.col("c_custkey") % 20 + 1).cast("int")
    word = lambda k: F.when(F.col("c_custkey") % 3 == 0, F.lit("lorem")).when(k == at, "RAVI").when(k == at + 1, "Verma,").otherwise("lorem")
    words = F.transform(i, lambda k: F.struct(word(k).alias("text"), F.struct((k * 50).alias("x1"), F.lit(0).alias("y1"), (k * 50 + 40).alias("x2"), F.lit(10).alias("y2")).alias("box")))
    # One word of two is enough, and windows are five words long: mostly the first window that reaches the phrase has
    # its first word only.
    # A key is few bytes and its line long, and one task may have read all keys: 20,000 lines a task.
    keys = table(spark, d, "customer").select("c_custkey")
    lines = computed(keys.repartition(-(-keys.count() // 20_000) or 1), "words", words)
    return computed(lines, "f", folds.phrase_box(F.col("words"), F.lit("Ravi Verma"))).where("f IS NOT NULL").select("c_custkey", "f.x1", "f.x2")


@query(f"""WITH {B} SELECT page_id, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS px, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) / 921600 AS pixel_fraction,
      CAST(count_if(side = 'O') AS DOUBLE) / count(*) AS element_fraction FROM b GROUP BY page_id""")
def disclosure_fractions(spark, d):
    b = boxes(spark, d)
    px = F.sum(area(F.col("box")).cast("bigint"))
    return b.groupBy("page_id").agg(px.alias("px"), (px / 921600).alias("pixel_fraction"), (F.count_if(F.col("side") == "O") / F.count("*")).alias("element_fraction"))
