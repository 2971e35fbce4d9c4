"""Queries on stored HTML: its elements, what labels them, where they lead, and what stands at a point."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hushframe.operators import tree
from hushframe.plans.inputs import table
from hushframe.sources.dom import elements_of_html
from hushframe.sources.staging import staged

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def nodes_of(pages, name):
    return staged(elements_of_html(pages), name)


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gsi') AS html FROM pages),
   t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>[^<]*')) AS tag, generate_subscripts(regexp_extract_all(html, '<[a-zA-Z][^>]*>[^<]*'), 1) AS k FROM h),
   e AS (SELECT page_id, k, lower(regexp_extract(tag, '^<([a-zA-Z][^\s/>]*)', 1)) AS tag, regexp_extract(tag, '\shref="([^"]*)"', 1) AS href, regexp_extract(tag, '>([^<]*)$', 1) AS text FROM t)
   SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS ord, tag, href,
          CASE WHEN tag = 'a' THEN trim(regexp_replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) ELSE '' END AS link_text
   FROM e WHERE tag IN ('input', 'textarea', 'select', 'button', 'td', 'th', 'p', 'span', 'div', 'img', 'label') OR (tag = 'a' AND href <> '')""")
def dom_elements(spark, d):
    """The selected elements of stored pages in document order."""
    n = elements_of_html(table(spark, d, "pages")).where(tree.is_selected())
    ord_ = F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1
    return n.select("page_id", ord_.alias("ord"), "tag", F.coalesce(tree.attr("href"), F.lit("")).alias("href"), F.when(F.col("tag") == "a", F.col("inner")).otherwise("").alias("link_text"))


#: One way to label an element for each order: markup, and the elements that it keeps with their labels.
NAME = "('Field ' || o_custkey)"
WAYS = [
    ("'<label for=\"f\">' || {n} || '</label><div><i></i><input id=f></div>'", [("label", "{n}"), ("input", "{n}")]),
    ("'<INPUT aria-label=\"' || {n} || '\">'", [("input", "{n}")]),
    ("'<b id=\"a\">' || {n} || '</b><i id=\"c\">two</i><input aria-labelledby=\"a  none c\">'", [("input", "{n} || ' two'")]),
    ("'<label>' || {n} || ' <em><input></em></label>'", [("label", "{n}"), ("input", "{n}")]),
    ("'<div><strong>' || {n} || '</strong> and more</div>'", [("div", "{n}")]),
    ("'<table><tr><td>' || {n} || '<td><p><input></table>'", [("td", "''"), ("input", "{n}")]),
    ("'<button> ' || {n} || '\n</button>'", [("button", "{n}")]),
    ("'<span>' || {n} || '</span><!-- <input> --><input>'", [("span", "''"), ("input", "{n}")]),
    ("'<img alt=\"\" title=\"' || {n} || '\">'", [("img", "{n}")]),
    ("'<div><p>x</p></div><input placeholder=''' || {n} || '''>'", [("p", "''"), ("input", "{n}")]),
    ("'<input aria-label=\" \" title=\"t\"><a href=\"/x\">' || {n} || '&amp;</a>'", [("input", "''"), ("a", "{n} || '&'")]),
]
_CASES = " ".join(f"WHEN {k} THEN {m.format(n=NAME)}" for k, (m, _) in enumerate(WAYS))
HTML = f"CASE o_orderkey % {len(WAYS)} {_CASES} END"
_KEPT = " UNION ALL ".join(
    f"SELECT o_orderkey AS page_id, '{tag}' AS tag, {label.format(n=NAME)} AS label FROM orders WHERE o_orderkey % {len(WAYS)} = {k}"
    for k, (_, kept) in enumerate(WAYS)
    for tag, label in kept
)


@query(_KEPT)
def dom_labels(spark, d):
    """Every way in which an element gets its label, by markup made of the orders."""
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.org/").alias("url"), F.expr(HTML).alias("html"))
    return tree.snapshot_of_html(nodes_of(pages, "dom-labels")).select("page_id", "tag", "label")


_TARGETS = ["https://a.org:443/x", "HTTPS://u:p@A.org/x", "http://a.org/x", "//a.org/x", "//b.org", "/x?y=1", "#z", "", "mailto:x@a.org", "https://a.org:8443/", "http://", "javascript:go()"]
_SAME = ["https://a.org", "https://a.org", "http://a.org", "https://a.org", "https://b.org", "https://a.org", "https://a.org", "https://a.org", "mailto:", "https://a.org:8443", "invalid", "javascript:"]
_SOURCE = ["local-control" if t == "" else "non-http-target" if s.endswith(":") else "invalid-target" if s == "invalid" else "resolved-target" for t, s in zip(_TARGETS, _SAME)]


def _pick(values):
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


@query(f"""SELECT o_orderkey AS page_id, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'button' ELSE 'input' END AS tag, {_pick(_SAME)} = 'https://a.org' AS same_origin, {_pick(_SAME)} AS target_origin,
          CASE WHEN o_custkey % 3 > 0 AND {_pick(_TARGETS)} = '' THEN 'resolved-target' ELSE {_pick(_SOURCE)} END AS origin_source FROM orders""")
def dom_targets(spark, d):
    """Where links, and buttons of a form with an address of their own or the form's, lead."""
    target = _pick(_TARGETS)
    html = f"""CASE o_custkey % 3 WHEN 0 THEN '<a href="' || {target} || '">x</a>' WHEN 1 THEN '<form action="' || {target} || '"><button>x</button></form>'
               ELSE '<form action="https://z.org"><input type=submit formaction="' || {target} || '"></form>' END"""
    html = f"CASE WHEN o_custkey % 3 = 2 AND {target} = '' THEN '<form action=\"/\"><input type=image formaction></form>' ELSE {html} END"
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://A.org:443/p").alias("url"), F.expr(html).alias("html"))
    return tree.snapshot_of_html(nodes_of(pages, "dom-targets")).select("page_id", "tag", "same_origin", "target_origin", "origin_source")


_P = "(SELECT o_orderkey AS page_id, CAST(o_custkey % 100 AS INT) AS x, CAST(o_orderkey % 97 AS INT) AS y FROM orders)"


@query(f"""WITH h AS (SELECT *, CASE WHEN x >= 30 AND x < 90 AND y >= 20 AND y < 80 THEN 4 WHEN x >= 20 AND x < 50 AND y >= 15 AND y < 35 THEN 3 WHEN x >= 10 AND x < 60 AND y >= 10 AND y < 40 THEN 1
             WHEN x < 95 AND y < 95 THEN 0 END AS hit FROM {_P})
   SELECT page_id, x, y, coalesce(hit, -1) AS hit, coalesce(CASE WHEN hit IN (1, 3) THEN 1 ELSE hit END, -1) AS acts FROM h""")
def actionable_at_point(spark, d):
    """A click's topmost element, and the link that it would follow."""
    html = "<div>top <a href='/go'><b><span></span>go <span>now</span></b></a><p>over</div>"
    o = table(spark, d, "orders")
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.org/").alias("url"), F.lit(html).alias("html"))
    box = F.expr("CASE snapshot_id WHEN 0 THEN array(0, 0, 95, 95) WHEN 1 THEN array(10, 10, 60, 40) WHEN 3 THEN array(20, 15, 50, 35) WHEN 4 THEN array(30, 20, 90, 80) END")
    e = tree.snapshot_of_html(nodes_of(pages, "at-point")).withColumn("_b", box)
    e = e.withColumn("box", F.struct(*(F.get("_b", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))).drop("_b")
    points = o.select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 100).cast("int").alias("x"), (F.col("o_orderkey") % 97).cast("int").alias("y"))
    at = tree.actionable_at(points, e)
    return at.select("page_id", "x", "y", F.coalesce("hit", F.lit(-1)).alias("hit"), F.coalesce("acts", F.lit(-1)).alias("acts"))
