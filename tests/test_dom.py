"""Elements of stored HTML against a tree built another way, and labels, targets and points by small pages."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from hushframe.operators import tree
from hushframe.sources import dom
from hushframe.sources.staging import staged


class Naive(HTMLParser):
    """A tree of nested lists; only paragraphs and list items may lack end tags."""

    def __init__(self):
        super().__init__()
        self.root = {"tag": "", "attrs": {}, "kids": [], "up": None}
        self.at, self.quiet = self.root, 0

    def handle_starttag(self, tag, attrs):
        if tag in dom.BLOCK:
            self._end("p", {"td", "th", "table", "button"})
        if tag == "li":
            self._end("li", {"ul", "ol"})
        node = {"tag": tag, "attrs": {}, "kids": [], "up": self.at}
        for k, v in attrs:
            node["attrs"].setdefault(k, v or "")
        self.at["kids"].append(node)
        if tag not in dom.VOID:
            self.at = node

    handle_startendtag = handle_starttag

    def _end(self, tag, stop):
        up = self.at
        while up["up"] is not None and up["tag"] not in stop:
            if up["tag"] == tag:
                self.at = up["up"]
                return
            up = up["up"]

    def handle_endtag(self, tag):
        self._end(tag, set())

    def handle_data(self, data):
        if self.at["tag"] not in ("script", "style"):
            self.at["kids"].append(data)


def flat(node, depth=0):
    if node["up"] is not None:
        own = " ".join("".join(k for k in node["kids"] if isinstance(k, str)).split())
        yield node["tag"], node["attrs"], depth - 1, own[:600].rstrip(), " ".join(inner(node).split())[:600].rstrip()
    for k in node["kids"]:
        if not isinstance(k, str):
            yield from flat(k, depth + 1)


def inner(node):
    out = []
    for k in node["kids"]:
        if isinstance(k, str):
            out.append(k)
        else:
            apart = " " if k["tag"] in dom._APART else ""
            out.append(apart + inner(k) + apart)
    return "".join(out)


def naive(page):
    p = Naive()
    p.feed(page)
    p.close()
    return list(flat(p.root))


def test_stored_pages_as_another_parser_reads_them(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {}
    for r in dom.elements_of_html(pages).orderBy("page_id", "start").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.attrs, r.depth, r.own, r.inner))
    for r in pages.collect():
        assert got[r.page_id] == naive(r.html), r.page_id


def test_intervals_nest_and_name_parents_and_siblings():
    rows = dom.scan("<ul><li>a<li>b <b>c</b><i>d</i></ul><p>x<div><td>odd</div></b><img src=q><br/>tail")
    at = {r[0]: dict(zip(dom._FIELDS, r)) for r in rows}
    assert sorted(x for r in rows for x in r[:2]) == list(range(2 * len(rows)))
    for r in at.values():
        inside = [o for o in at.values() if o["start"] < r["start"] and r["end"] < o["end"]]
        assert r["depth"] == len(inside) and r["parent"] == max((o["start"] for o in inside), default=-1)
        before = [o["start"] for o in at.values() if o["parent"] == r["parent"] and o["start"] < r["start"]]
        assert r["prev"] == max(before, default=-1)
        assert r["children"] == sum(o["parent"] == r["start"] for o in at.values())
    assert [r[6] for r in rows] == ["ul", "li", "li", "b", "i", "p", "div", "td", "img", "br"]
    assert next(r for r in rows if r[6] == "ul")[9] == "a b cd"


@pytest.mark.parametrize(
    "page, tags",
    [
        (None, []),
        ("", []),
        ("< b", []),
        ("a < b <c", ["c"]),
        ("<!-- <p> ", []),
        ("<script>if (a<b) '<p>'", ["script"]),
        ('<p title="', ["p"]),
        ('<p title="><b>', ["p", "b"]),
        ("<P CLASS=a class=b>x", ["p"]),
        ("<textarea><b>&lt;</textarea><b>", ["textarea", "b"]),
        ("<table><tr><th>a<td>b<tr><td>c</table>", ["table", "tr", "th", "td", "tr", "td"]),
        ("<select><option>a<option selected>b</select>", ["select", "option", "option"]),
        ("</p></p>", []),
    ],
)
def test_broken_markup(page, tags):
    assert [r[6] for r in dom.scan(page)] == tags


def test_time_grows_with_the_page():
    def seconds(part, times):
        began = time.process_time()
        dom.scan(part * times)
        return time.process_time() - began

    for part in ("<div>a <b>b", "<p><i>x</i>", "<li>", "<!-- ", "<a href='", "<ul><li>", "</b>", "<script>", "<"):
        assert seconds(part, 300_000 // len(part)) < 5, part
    dom.scan("<div>" * 200_000)


def labels(spark, html):
    pages = spark.createDataFrame([(1, "https://a.org/x", html)], "page_id long, url string, html string")
    s = tree.snapshot_of_html(staged(dom.elements_of_html(pages), "t"))
    return {r.snapshot_id: r for r in s.collect()}


def test_the_first_way_that_is_not_blank_labels(spark):
    got = labels(
        spark,
        "<label for=f> </label><label>Wrap <input id=f placeholder=P></label>"  # the label that names it is blank
        "<div><em>e</em><strong>no</strong>text</div>"  # strong is not the first child
        "<table><tr><th>Cell</th><td><span>in</span></td></tr></table>"
        "<select id=s><option value=v1><option selected>Two</option></select>",
    )
    # The first label and the second cell have no text of their own, and are no controls.
    assert [(got[k].tag, got[k].label) for k in sorted(got)] == [("label", "Wrap"), ("input", "Wrap"), ("div", ""), ("th", ""), ("span", "Cell"), ("select", "Two")]
    last = got[max(got)]
    assert last.options == ["v1", "Two"] and last.text == "Two" and last.role == "combobox"


def test_fields_of_controls(spark):
    got = labels(
        spark,
        "<input type=PASSWORD autocomplete=one-time-code><input inputmode=numeric maxlength=6><input type=checkbox disabled><textarea> a\nb </textarea>"
        "<div role=button aria-disabled=true>Go</div><p></p><button>Send <b>it</b></button><select>" + "".join(f"<option>{k}" for k in range(60)) + "</select>",
    )
    r = [got[k] for k in sorted(got)]
    assert [x.input_type for x in r[:4]] == ["password", "otp", "checkbox", "text"]
    assert [x.role for x in r] == ["textbox", "textbox", "checkbox", "textbox", "button", "button", "combobox"]
    assert [x.enabled for x in r] == [True, True, False, True, False, True, True]
    assert r[3].text == "a b" and r[5].text == "Send" and r[5].label == "it" and r[6].options == [str(k) for k in range(40)]
    assert [x.snapshot_id for x in r] == [0, 1, 2, 3, 4, 6, 7]


def test_nearest_enclosing_is_the_innermost_that_is_open(spark):
    html = "<div id=a><div id=b><p>1</p></div><p>2</p><div id=c></div></div><p>3</p>"
    nodes = dom.elements_of_html(spark.createDataFrame([(k, "u", html) for k in (1, 2)], "page_id long, url string, html string"))
    n = tree.with_enclosing(nodes, {"box": (F.col("tag") == "div", tree.attr("id")), "none": (F.col("tag") == "td", F.lit(1))})
    got = {(r.page_id, r.inner, r.tag): (r.box, r.none) for r in n.collect() if r.tag == "p"}
    assert got == {(k, t, "p"): (b, None) for k in (1, 2) for t, b in (("1", "b"), ("2", "a"), ("3", None))}


def test_tasks_that_bring_pages_together_grow_with_their_elements(spark, monkeypatch):
    monkeypatch.setattr(tree, "TASK_ELEMENTS", 10)
    html = '<b id="a">one</b><label for="f">two</label><input id="f"><input aria-labelledby="a f"><button>three</button>'
    pages = spark.createDataFrame([(k, "https://a.org/", html) for k in range(20)], "page_id long, url string, html string")
    nodes = staged(dom.elements_of_html(pages), "t")
    found = tree.labelled(nodes)
    assert found.rdd.getNumPartitions() == 10
    assert {(r.start, r.label, r["count"]) for r in found.groupBy("start", "label").count().collect()} == {(0, "", 20), (2, "two", 20), (4, "two", 20), (6, "one", 20), (8, "three", 20)}
