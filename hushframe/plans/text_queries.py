"""Queries on personal data, redaction and text metrics over documents, pages and derived labelled values."""

from pyspark.sql import functions as F

from hushframe.functions import rules, spans, text
from hushframe.functions.checksum import INVERSES, PLACES, PRODUCTS, verhoeff_digit, verhoeff_ok
from hushframe.functions.shadow import SHADOW_SQL, shadow
from hushframe.operators import metrics, snapshot
from hushframe.operators.folds import first_fit
from hushframe.operators.text_rows import detect_rows, labelled_rows
from hushframe.plans.inputs import table
from hushframe.sources import corpus, pages

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# What RE2 reads as Java and Python do: classes in ASCII, on shadow text.
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"
ACCOUNT = r"\b[0-9]{11,16}\b"
PHONE = dict(rules.TEXT_FORMATS)["PHONE"]
BOUNDED = dict(rules.PAGE_FORMATS)["PHONE"]
SHADOW = SHADOW_SQL.format("text")


def duck_spans(s: str, pattern: str) -> str:
    """Matches in s as a list of {s, e} (0-based, end exclusive)."""
    m, g = f"regexp_extract_all({s}, '{pattern}')", f"string_split_regex({s}, '{pattern}')"
    upto = lambda x, n: f"coalesce(list_sum(list_transform(({x})[1:{n}], lambda q: length(q))), 0)"
    start = f"{upto(g, 'i')} + {upto(m, 'i - 1')}"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': {start}, 'e': {start} + length(({m})[i])}})"


@query(rf"""
    WITH f AS (SELECT lang, regexp_extract_all(s, '{EMAIL}') e, regexp_extract_all(s, '{ACCOUNT}') a FROM (SELECT lang, {SHADOW} s FROM documents))
    SELECT lang, count(*) n_docs, CAST(sum(len(e)) AS BIGINT) n_email, CAST(sum(len(a)) AS BIGINT) n_account,
           CAST(sum(coalesce(list_sum(list_transform(e, lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)) AS BIGINT) span_chars
    FROM f GROUP BY lang""")
def pii_span_counts(spark, d):
    """Per language: documents, e-mail and account spans, and the code points of those spans."""
    found = table(spark, d, "documents").select("lang", shadow(F.col("text")).alias("s")).select(
        "lang",
        F.regexp_extract_all("s", F.lit(EMAIL), F.lit(0)).alias("email"),
        F.regexp_extract_all("s", F.lit(ACCOUNT), F.lit(0)).alias("account"),
    )
    chars = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return found.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("email")).alias("n_email"),
        F.sum(F.size("account")).alias("n_account"),
        F.sum(chars("email") + chars("account")).alias("span_chars"),
    )


_EACH = " UNION ALL ".join(
    f"SELECT kind, id, '{c}' AS cls, text, unnest({duck_spans('sh', p)}) AS x FROM t"
    for c, p in (("EMAIL", EMAIL), ("ACCOUNT", ACCOUNT), ("PHONE", PHONE))
)


@query(rf"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, text, {SHADOW} AS sh FROM documents
    UNION ALL SELECT 'p', page_id, html, {SHADOW_SQL.format('html')} FROM pages)
    SELECT kind, id, cls, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end", substr(text, CAST(x.s AS INT) + 1, CAST(x.e - x.s AS INT)) AS text FROM ({_EACH})""")
def pii_spans_with_offsets(spark, d):
    docs = table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    both = docs.union(table(spark, d, "pages").select(F.lit("p"), "page_id", "html"))
    found = spans.with_matches(both, "text", {c: (c, p) for c, p in (("EMAIL", EMAIL), ("ACCOUNT", ACCOUNT), ("PHONE", PHONE))})
    return found.select("kind", "id", F.explode(F.concat("EMAIL", "ACCOUNT", "PHONE")).alias("x")).select("kind", "id", "x.*")


_REDACT = rf"""WITH t AS (SELECT doc_id, text, {SHADOW} AS sh FROM documents),
    c AS (SELECT doc_id, text, {duck_spans('sh', EMAIL)} AS em, {duck_spans('sh', PHONE)} AS ph, {duck_spans('sh', ACCOUNT)} AS ac FROM t),
    k AS (SELECT doc_id, text, list_sort(list_concat(list_transform(em, lambda x: {{'s': x.s, 'e': x.e, 't': '[EMAIL_1]'}}),
          list_transform(list_filter(ph, lambda x: len(list_filter(em, lambda q: q.s <= x.s AND x.s < q.e)) = 0), lambda x: {{'s': x.s, 'e': x.e, 't': '[PHONE_1]'}}),
          list_transform(list_filter(ac, lambda x: len(list_filter(list_concat(em, ph), lambda q: q.s <= x.s AND x.s < q.e)) = 0), lambda x: {{'s': x.s, 'e': x.e, 't': '[ACCOUNT_1]'}}))) AS sp FROM c),
    r AS (SELECT doc_id, text, list_reduce(list_prepend({{'at': CAST(0 AS BIGINT), 'out': '', 's': CAST(0 AS BIGINT), 't': ''}},
          list_transform(sp, lambda x: {{'at': CAST(x.e AS BIGINT), 'out': '', 's': CAST(x.s AS BIGINT), 't': x.t}})),
          lambda a, x: CASE WHEN x.s < a.at THEN a ELSE {{'at': x.at, 'out': a.out || substr(text, a.at + 1, x.s - a.at) || x.t, 's': x.s, 't': x.t}} END) AS z FROM k)"""


@query(_REDACT + " SELECT doc_id, sha256(z.out || substr(text, z.at + 1)) AS redacted FROM r")
def redact_documents(spark, d):
    docs = spans.redacted(table(spark, d, "documents").select("doc_id", "text"), "text", "clean")
    return docs.select("doc_id", F.sha2("clean", 256).alias("redacted"))


@query(_REDACT + """, x AS (SELECT lang, CAST(sum(octet_length(encode(z.out || substr(r.text, z.at + 1)))) AS BIGINT) AS clean_bytes, CAST(sum(octet_length(encode(r.text))) AS BIGINT) AS raw_bytes
    FROM r JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, clean_bytes, raw_bytes, CAST(clean_bytes AS DOUBLE) / raw_bytes AS ratio FROM x""")
def exposure_ratio(spark, d):
    docs = spans.redacted(table(spark, d, "documents"), "text", "clean")
    return metrics.exposure(docs, "text", "clean", "lang")


@query(rf"""WITH t AS (SELECT doc_id, text, {SHADOW} AS sh FROM documents),
    a AS (SELECT doc_id, text, {duck_spans('sh', EMAIL)} AS em FROM t),
    b AS (SELECT doc_id, list_reduce(list_prepend({{'at': CAST(0 AS BIGINT), 'out': '', 's': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}},
          list_transform(em, lambda x: {{'at': CAST(x.e AS BIGINT), 'out': '', 's': CAST(x.s AS BIGINT), 'n': CAST(0 AS BIGINT)}})),
          lambda a, x: {{'at': x.at, 'out': a.out || substr(text, a.at + 1, x.s - a.at) || '[EMAIL_' || (a.n + 1) || ']', 's': x.s, 'n': a.n + 1}}) AS z, text FROM a)
    SELECT doc_id, z.n AS n_email, CAST(regexp_matches(text, '[^ -~]') AS BOOLEAN) AS wide, sha256(z.out || substr(text, z.at + 1)) AS tokenised FROM b""")
def tokenise_emails(spark, d):
    t = F.col("text")
    found = text.spans_of(t, EMAIL, "EMAIL")
    out = text.splice(t, F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("[EMAIL_"), i + 1, F.lit("]")).alias("token"))))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("bigint").alias("n_email"), t.rlike("[^ -~]").alias("wide"), F.sha2(out, 256).alias("tokenised"))


@query(rf"""WITH f AS (SELECT doc_id, {SHADOW} AS s FROM documents)
    SELECT doc_id, s_ AS shadow_name FROM (SELECT doc_id, unnest(regexp_extract_all(s, '{rules.NAME}')) AS s_ FROM f WHERE length(s) >= 25) WHERE s_ NOT IN ({", ".join(repr(x) for x in rules.NOT_NAMES["runtime"])})""")
def name_candidates(spark, d):
    """Names in free text (no document has an address of the pattern's shape)."""
    return table(spark, d, "documents").select("doc_id", F.explode(text.contextual_spans(F.col("text"), "runtime")).alias("x")).select("doc_id", shadow(F.col("x.text")).alias("shadow_name"))


@query(rf"""SELECT lang, CAST(sum(len(regexp_extract_all(s, '{PHONE}'))) AS BIGINT) AS suffix_phone, CAST(sum(len(regexp_extract_all(s, '{BOUNDED}'))) AS BIGINT) AS bounded_phone
    FROM (SELECT lang, {SHADOW} AS s FROM documents) GROUP BY lang""")
def suffix_phone_vs_bounded(spark, d):
    n = lambda p: F.sum(F.size(F.regexp_extract_all("s", F.lit(p), F.lit(0))))
    return table(spark, d, "documents").select("lang", shadow(F.col("text")).alias("s")).groupBy("lang").agg(n(PHONE).alias("suffix_phone"), n(BOUNDED).alias("bounded_phone"))


def _duck_verhoeff(digits: str, n: int, first: int) -> str:
    place = f"{PLACES}[((i + {first}) % 8) * 10 + CAST({digits}[{n} - i] AS INT) + 1]"
    return f"list_reduce(list_prepend(0, list_transform(range({n}), lambda i: {place})), lambda c, p: {PRODUCTS}[c * 10 + p + 1])"


@query(f"""WITH k AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 20000000000) % 100000000000 AS VARCHAR), 11, '2') AS e FROM orders)
    SELECT o_orderkey, e || {INVERSES}[{_duck_verhoeff('e', 11, 1)} + 1] AS valid, {_duck_verhoeff("(e || (o_orderkey % 10))", 12, 0)} = 0 AS ok FROM k""")
def verhoeff_valid_keys(spark, d):
    e = F.lpad(((F.col("o_orderkey") * 7919 + 20000000000) % 100000000000).cast("string"), 11, "2")
    o = table(spark, d, "orders").select("o_orderkey", e.alias("e"))
    return o.select("o_orderkey", F.concat("e", verhoeff_digit(F.col("e")).cast("string")).alias("valid"), verhoeff_ok(F.concat("e", (F.col("o_orderkey") % 10).cast("string"))).alias("ok"))


#: A label and a value for each customer.
_LABEL = "CASE c_custkey % 9 WHEN 0 THEN 'PAN' WHEN 1 THEN 'Email' WHEN 2 THEN 'Account Number' WHEN 3 THEN 'Applicant Name' WHEN 4 THEN 'Date of Birth' WHEN 5 THEN 'Account Holder' WHEN 6 THEN 'Employee ID' WHEN 7 THEN 'Remarks' ELSE 'Address' END"
_VALUE = (
    "CASE c_custkey % 7 WHEN 0 THEN 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0') || 'F' WHEN 1 THEN 'c' || CAST(c_custkey AS VARCHAR(9)) || '@example.org'"
    " WHEN 2 THEN '30' || lpad(CAST(c_custkey AS VARCHAR(9)), 11, '0') WHEN 3 THEN 'Ravi Verma' WHEN 4 THEN '0' || CAST(c_custkey % 9 + 1 AS VARCHAR(9)) || '/11/1987'"
    " WHEN 5 THEN 'EMP' || lpad(CAST(c_custkey % 100000 AS VARCHAR(9)), 5, '0') ELSE ' ' END"
)


def _duck_classify(profile: str) -> str:
    hint = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(label), '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in rules.HINTS[profile]) + " END"
    found = " ".join(f"WHEN hint = '{c}' AND regexp_matches(t, '{p}') THEN hint" for c, p in rules.FORMATS[profile] if c != "AADHAAR")
    shape = " ".join(
        f"WHEN regexp_matches(t, '{p}')" + (" AND coalesce(hint, 'ACCOUNT') = 'ACCOUNT'" if c == "ACCOUNT" else "") + f" THEN '{c}'"
        for c, p in rules.FORMATS[profile] if c != "AADHAAR"
    )
    name = rules.NAME.replace("\\b", "")
    return f"""(SELECT c_custkey, '{profile}' AS profile, CASE WHEN t = '' THEN NULL {found} {shape} WHEN hint = 'PERSON' AND regexp_full_match(t, '{name}') THEN 'PERSON'
        WHEN hint NOT IN ('PERSON', 'ACCOUNT') THEN hint END AS cls FROM (SELECT c_custkey, trim(value) AS t, {hint} AS hint FROM v))"""


@query(f"WITH v AS (SELECT c_custkey, {_LABEL} AS label, {_VALUE} AS value FROM customer) " + " UNION ALL ".join(_duck_classify(p) for p in rules.PROFILES))
def classify_labelled_values(spark, d):
    v = table(spark, d, "customer").select("c_custkey", F.expr(_LABEL).alias("label"), F.expr(_VALUE).alias("value"))
    kinds = F.array(*(F.struct(F.lit(p).alias("profile"), text.classify(F.col("value"), F.col("label"), p).alias("cls")) for p in rules.PROFILES))
    return v.select("c_custkey", F.explode(kinds).alias("k")).select("c_custkey", "k.*")


@query(f"""WITH v AS (SELECT c_custkey, {_LABEL} AS label, {_VALUE} AS value FROM customer),
   h AS (SELECT *, CASE WHEN label = 'PAN' THEN 'PAN' WHEN label = 'Email' THEN 'EMAIL' WHEN label = 'Account Number' THEN 'ACCOUNT' WHEN label = 'Applicant Name' THEN 'PERSON'
     WHEN label = 'Date of Birth' THEN 'DOB' WHEN label = 'Employee ID' THEN 'PERSON' WHEN label = 'Address' THEN 'ADDRESS' END AS cls FROM v)
   SELECT c_custkey, cls, value, CAST(length('<tr><td class=''label''>' || label || '</td><td class=''value''>') AS INT) AS start FROM h
   WHERE cls IS NOT NULL AND CASE cls WHEN 'PAN' THEN regexp_full_match(value, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') WHEN 'EMAIL' THEN contains(value, '@')
     WHEN 'ACCOUNT' THEN regexp_full_match(value, '[0-9]{{9,18}}') ELSE true END""")
def label_row_detect(spark, d):
    row = F.concat(F.lit("<tr><td class='label'>"), F.expr(_LABEL), F.lit("</td><td class='value'>"), F.expr(_VALUE), F.lit("</td></tr>"))
    v = table(spark, d, "customer").select("c_custkey", F.explode(labelled_rows(row)).alias("x"))
    return v.select("c_custkey", "x.cls", F.col("x.text").alias("value"), "x.start")


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)', 1)) AS href FROM pages)
    SELECT page_id, href, regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = '' AND NOT starts_with(href, '//') AS same_origin, count(*) AS n FROM l GROUP BY ALL""")
def link_origin(spark, d):
    l = pages.links(table(spark, d, "pages"))
    return l.groupBy("page_id", "href", snapshot.same_origin(F.col("href"), F.col("url")).alias("same_origin")).agg(F.count("*").alias("n"))


@query(rf"""WITH f AS (SELECT lang, unnest(regexp_extract_all(s, '{ACCOUNT}')) AS x FROM (SELECT lang, {SHADOW} AS s FROM documents))
    SELECT lang, CAST(sum(CASE WHEN x[1] NOT IN ('6', '7', '8', '9') THEN length(x) ELSE 0 END) AS BIGINT) AS leaked, CAST(sum(length(x)) AS BIGINT) AS chars,
    CAST(sum(CASE WHEN x[1] NOT IN ('6', '7', '8', '9') THEN length(x) ELSE 0 END) AS DOUBLE) / sum(length(x)) AS rate FROM f GROUP BY lang""")
def leakage_by_lang(spark, d):
    """Account numbers as gold, those that begin like a phone number as found."""
    s = table(spark, d, "documents").select("lang", F.explode(text.spans_of(F.col("text"), ACCOUNT, "ACCOUNT")).alias("x"))
    return metrics.leakage(s.select("lang", F.length("x.text").alias("chars"), F.col("x.text").rlike("^[6-9]").alias("matched")), "lang")


@query(r"""WITH p AS (SELECT quality, toxic, n_chars < 900 AS short FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS cls, CAST(count_if(short AND quality = 0) AS BIGINT) AS tp, CAST(count_if(short AND quality = 1) AS BIGINT) AS fp, CAST(count_if(NOT short AND quality = 0) AS BIGINT) AS fn FROM p GROUP BY ALL),
    a AS (SELECT * FROM c UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c)
    SELECT cls, tp, fp, fn, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
           coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM a""")
def prf_by_label(spark, d):
    """Short documents as predictions of low quality, by toxicity and in all."""
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    short, low = F.col("n_chars") < 900, F.col("quality") == 0
    one = lambda c: c.cast("bigint")
    rows = p.select(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("cls"), one(short & low).alias("tp"), one(short & ~low).alias("fp"), one(~short & low).alias("fn"))
    return metrics.per_class_and_micro(rows)


@query(r"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text[1:40] ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedupe_snapshot(spark, d):
    docs = table(spark, d, "documents").withColumn("_head", F.substring("text", 1, 40))
    return snapshot.first_of_each(docs, ["lang", "_head"], ["doc_id"]).select("doc_id")


@query("SELECT conv_id, turn, sha256(text)[1:12] AS goal_hash, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM conversations")
def audit_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 12).alias("goal_hash"), F.octet_length("text").cast("bigint").alias("bytes"))


@query()
def generated_text_scores(spark, d):
    """The text detector on generated pages against their gold: a page for each twenty orders."""
    n = max(60, table(spark, d, "orders").count() // 20)
    made = corpus.text_pages(spark, n)
    found = detect_rows(made).withColumn(
        "found", F.transform("entities", lambda e, i: F.struct(e["cls"].alias("cls"), e["start"].alias("start"), e["end"].alias("end"), i.alias("ord")))
    )
    matched = found.select("gold", "found", first_fit(F.col("gold"), F.col("found")).alias("used"))
    one = lambda cls, tp, fp, fn: F.struct(cls.alias("cls"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    zero = F.lit(0).cast("bigint")
    hits = F.zip_with("gold", "used", lambda g, u: one(g["cls"], (u >= 0).cast("bigint"), zero, (u < 0).cast("bigint")))
    extra = F.transform(F.filter("found", lambda e: ~F.array_contains("used", e["ord"])), lambda e: one(e["cls"], zero, F.lit(1).cast("bigint"), zero))
    return metrics.per_class_and_micro(matched.select(F.explode(F.concat(hits, extra)).alias("x")).select("x.*"))


_MIXED = f"((id + {7 * 7919}) % 1000003 * 48271 + {7 * 104729 + 11}) % 2147483647"


_LEFT = f"((id + {200 * 7919}) % 1000003 * 48271 + {200 * 104729 + 11}) % 2147483647"
_LABELS = [corpus.LABELS[c] for c in corpus.FIELDS] + ["Download Certificate"]


@query(f"""WITH p AS (SELECT unnest(range((SELECT greatest(48, count(*) // 100) FROM orders))) AS id),
   f AS (SELECT id, ['scholarship', 'hr', 'health', 'municipal', 'banking', 'transport'][({_MIXED}) * 16807 % 2147483647 // 7 % 6 + 1] AS family, ({_LEFT}) * 16807 % 2147483647 // 7 % 60 + 40 AS x FROM p),
   c AS (SELECT unnest(range({len(_LABELS)})) AS ord, unnest({[*corpus.FIELDS]} || [NULL]) AS cls, unnest({_LABELS}) AS label)
   SELECT family || '_' || lpad(CAST(id AS VARCHAR), 8, '0') AS page_id, CAST(ord AS INT) AS ord, CASE WHEN family IN ('scholarship', 'hr') THEN 'dev' ELSE 'test' END AS split, cls, label,
          CASE WHEN cls IS NULL THEN 'button' ELSE 'text' END AS role, CAST(x AS INT) AS x1, CAST(ord * 52 + 90 AS INT) AS y1, CAST(x + 360 AS INT) AS x2, CAST(ord * 52 + 130 AS INT) AS y2 FROM f, c""")
def generated_portals(spark, d):
    n = max(48, table(spark, d, "orders").count() // 100)
    return corpus.visual_pages(spark, n).select("page_id", "ord", "split", "cls", "label", "role", "box.*")


def _duck_tokenised() -> str:
    """One step for each class, as each looks at what the one before it has written."""
    steps, last = ["s0 AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 1 THEN ' ask a.b@example.org' WHEN 2 THEN ' EMP12345 and ABCDE1234F, ABCDE1234G' WHEN 3 THEN ' +91 9876543210 on 01/02/1990' ELSE '' END AS text FROM conversations)"], "s0"
    for i, (cls, pattern) in enumerate(rules.FORMATS["browser"], 1):
        valid = ""
        if cls == "AADHAAR":
            plain = "regexp_replace(substr(text, CAST(x.s AS INT) + 1, CAST(x.e - x.s AS INT)), '[^0-9]', '', 'g')"
            valid = f" WHERE {_duck_verhoeff(plain, 12, 0)} = 0"
        steps.append(f"p{i} AS (SELECT conv_id, turn, text, unnest({duck_spans('sh', pattern)}) AS x FROM (SELECT *, {SHADOW} AS sh FROM {last}))")
        steps.append(
            f"""r{i} AS (SELECT conv_id, turn, x.s AS s, x.e AS e, row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.s) AS n,
            lag(x.e, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY x.s) AS since, text FROM p{i}{valid})"""
        )
        steps.append(
            f"""s{i} AS (SELECT t.conv_id, t.turn, CASE WHEN g.o IS NULL THEN t.text ELSE g.o || substr(t.text, CAST(g.e AS INT) + 1) END AS text FROM {last} t LEFT JOIN
            (SELECT conv_id, turn, max(e) AS e, string_agg(substr(text, CAST(since AS INT) + 1, CAST(s - since AS INT)) || '[{cls}_' || n || ']', '' ORDER BY s) AS o FROM r{i} GROUP BY ALL) g
            ON g.conv_id = t.conv_id AND g.turn = t.turn)"""
        )
        last = f"s{i}"
    return f"WITH {', '.join(steps)} SELECT conv_id, turn, text FROM {last}"


@query(_duck_tokenised())
def tokenise_goals(spark, d):
    """All shapes of the browser profile as numbered tokens, of turns to most of which something personal is added."""
    more = F.when(F.col("turn") % 4 == 1, " ask a.b@example.org").when(F.col("turn") % 4 == 2, " EMP12345 and ABCDE1234F, ABCDE1234G")
    more = more.when(F.col("turn") % 4 == 3, " +91 9876543210 on 01/02/1990").otherwise("")
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", more).alias("text"))
    return text.tokenised(turns, "text")
