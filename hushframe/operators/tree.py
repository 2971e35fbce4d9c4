"""Elements of a page's tree: what encloses them, what labels them, where they lead. No join runs over pairs of a page's
elements: sweeps in document order and equality joins on ids."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators import snapshot
from hushframe.sources.staging import staged

# Which elements a snapshot takes, which of them act, and which it keeps without text.
SELECTED = ("input", "textarea", "select", "button", "td", "th", "p", "span", "div", "img", "label")
ACTING, ACTING_ROLES = ("input", "textarea", "select", "button"), ("button", "link", "textbox", "combobox")
CONTROLS = ("input", "button", "select", "textarea", "a", "img")
LABEL, TEXT, OPTION, OPTIONS = 120, 600, 80, 40
#: Elements of a task, about, where those of a page come together. The bytes of a shuffle say little of what a task then
#: holds and sorts, as markup packs many times over.
TASK_ELEMENTS = 100_000


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def is_selected() -> Column:
    return F.col("tag").isin(*SELECTED) | ((F.col("tag") == "a") & attr("href").isNotNull()) | attr("role").isNotNull()


def is_actionable() -> Column:
    return F.col("tag").isin(*ACTING) | ((F.col("tag") == "a") & attr("href").isNotNull()) | F.coalesce(attr("role").isin(*ACTING_ROLES), F.lit(False))


def with_enclosing(nodes: DataFrame, holders: dict[str, tuple[Column, Column]], page: str = "page_id") -> DataFrame:
    """Adds, under each name, a value of the innermost element around a node (itself included) that a condition holds for;
    null without one. holders: by name the condition and the value.

    One sweep over the opens and closes of a page: a node stands in as many holders as were opened and not closed before
    it, and in that many the last one opened is the innermost. A page is sorted by two keys, whatever its elements.
    """
    conditions = {f"_is_{n}": F.coalesce(c, F.lit(False)) for n, (c, _) in holders.items()}
    values = {f"_of_{n}": F.struct(v.alias("v")) for n, (_, v) in holders.items()}
    marked = nodes.withColumns({**conditions, **values})
    marked = marked.withColumn("_opens", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_at", F.when(F.col("_opens"), F.col("start")).otherwise(F.col("end")))
    # The closing event carries no more than its place.
    e = marked.select(page, "_at", "_opens", *conditions, *(F.when(F.col("_opens"), F.col(c)).alias(c) for c in [*(c for c in nodes.columns if c != page), *values]))
    upto = Window.partitionBy(page).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda n: F.when(F.col(f"_is_{n}"), F.when(F.col("_opens"), 1).otherwise(-1)).otherwise(0)
    e = e.withColumns({f"_level_{n}": F.sum(step(n)).over(upto) for n in holders})
    for n in holders:
        same = Window.partitionBy(page, f"_level_{n}").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        held = F.last(F.when(F.col("_opens") & F.col(f"_is_{n}"), F.col(f"_of_{n}")), ignorenulls=True).over(same)
        e = e.withColumn(f"_in_{n}", F.when(F.col(f"_level_{n}") > 0, held))
    return e.where("_opens").select(*nodes.columns, *(F.col(f"_in_{n}.v").alias(n) for n in holders))


def labelled(nodes: DataFrame) -> DataFrame:
    """Adds label to the elements of ``sources.dom``: the first that is not blank of

    the text of the first label that names the element's id; aria-label (which counts as soon as it is there, even of
    white space); the texts of the elements that aria-labelledby names; the label around it; a b, strong or label
    that is its first child; what stands before the cell around it; for buttons, links and selections their own text;
    the element before it, if that has no children; alt, title or placeholder, the first that is there.

    nodes are counted and read several times: give a stored table. What ids lead to comes as further rows of a page, so that
    whole elements cross the network once, by page, and stay together for what reads whole pages after this.
    """
    inner = snapshot.cleaned(F.col("inner"), LABEL)
    near = Window.partitionBy("page_id", "parent").orderBy("start")
    first = lambda key: nodes.where((key.isNotNull()) & (key != "")).groupBy("page_id", key.alias("_key")).agg(F.min_by(inner, "start").alias("_text"))
    named = first(F.when(F.col("tag") == "label", attr("for")))
    id_ = F.nullif(attr("id"), F.lit(""))
    fors = nodes.select("page_id", "start", id_.alias("_id")).where("_id IS NOT NULL").join(named.withColumnsRenamed({"_key": "_id", "_text": "_for"}), ["page_id", "_id"])
    ids = nodes.select("page_id", "start", F.posexplode(F.split(attr("aria-labelledby"), r"\s+")).alias("_i", "_key")).where("_key <> ''")
    texts = ids.join(first(attr("id")), ["page_id", "_key"]).where("_text <> ''").groupBy("page_id", "start")
    texts = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_text"))), lambda x: x["_text"]), " ").alias("_by"))
    found = fors.unionByName(texts, allowMissingColumns=True).withColumn("_found", F.lit(True)).distinct()
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // TASK_ELEMENTS))
    n = nodes.withColumn("_id", id_).unionByName(found, allowMissingColumns=True).repartition(parts, "page_id")
    n = n.withColumns({
        "_for": F.max("_for").over(Window.partitionBy("page_id", "start", "_id")),
        "_by": F.max("_by").over(Window.partitionBy("page_id", "start")),
    }).where("_found IS NULL")
    near = Window.partitionBy("page_id", "parent").orderBy("start")
    n = n.withColumns({
        "_before": F.lag(inner).over(near),
        "_before_leaf": F.lag(F.col("children") == 0).over(near),
        "_next": F.lead(F.struct("tag", inner.alias("inner"))).over(Window.partitionBy("page_id").orderBy("start")),
    })
    n = with_enclosing(n, {"_wrap": (F.col("tag") == "label", inner), "_cell": (F.col("tag").isin("td", "th"), F.col("_before"))})
    filled = lambda c: (F.coalesce(c, F.lit("")) != "", c)
    short = lambda c: snapshot.cleaned(c, LABEL)
    own_child = F.when((F.col("children") > 0) & F.col("_next.tag").isin("b", "strong", "label"), F.col("_next.inner"))
    last = F.coalesce(*(F.nullif(attr(a), F.lit("")) for a in ("alt", "title", "placeholder")))
    ways = [
        filled(F.col("_for")),
        (F.coalesce(attr("aria-label"), F.lit("")) != "", short(attr("aria-label"))),
        filled(short(F.col("_by"))),
        filled(F.col("_wrap")),
        filled(own_child),
        filled(F.col("_cell")),
        filled(F.when(F.col("tag").isin("button", "a", "select"), inner)),
        filled(F.when(F.col("_before_leaf"), F.col("_before"))),
    ]
    label = F.when(*ways[0])
    for way in ways[1:]:
        label = label.when(*way)
    return n.withColumn("label", label.otherwise(short(last))).select(*nodes.columns, "label")


def target_of(raw: Column, page_url: Column) -> Column:
    """struct<same_origin, target_origin, origin_source> of where an element leads; null or empty: it stays on the page.

    An origin has neither user info nor the scheme's own port. Only http and https addresses can be of the same origin.
    """
    raw = F.trim(raw)
    own = snapshot.origin(page_url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    away = F.startswith(raw, F.lit("//"))
    full = F.when(away, F.concat(F.lower(F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)), raw)).otherwise(raw)
    says = lambda same, origin, source: F.struct(same.alias("same_origin"), origin.alias("target_origin"), F.lit(source).alias("origin_source"))
    there = snapshot.origin(full)
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", says(F.lit(True), own, "local-control"))
        .when((scheme == "") & ~away, says(F.lit(True), own, "resolved-target"))
        .when(~away & ~scheme.isin("http", "https"), says(F.lit(False), F.concat(scheme, F.lit(":")), "non-http-target"))
        .when(there.isNull(), says(F.lit(False), F.lit("invalid"), "invalid-target"))
        .otherwise(says(F.coalesce(there == own, F.lit(False)), there, "resolved-target"))
    )


def snapshot_of_html(nodes: DataFrame) -> DataFrame:
    """The elements that a snapshot of the page keeps: page_id, snapshot_id, tag, role, text, label, same_origin,
    target_origin, origin_source, input_type, autocomplete, inputmode, maxlength, options, enabled.

    snapshot_id numbers the page's selected elements in document order; those without text that are no controls are
    left out. There is no layout: boxes come from elsewhere, by snapshot_id. nodes: see ``labelled``.
    """
    inner = lambda most: snapshot.cleaned(F.col("inner"), most)
    kind = F.lower(F.coalesce(F.nullif(attr("type"), F.lit("")), F.when(F.col("tag") == "button", "submit").otherwise("text")))
    form = F.struct(F.coalesce(attr("action"), F.lit("")).alias("action"))
    n = with_enclosing(labelled(nodes), {"_form": (F.col("tag") == "form", form), "_select": (F.col("tag") == "select", F.col("start")), "_acts": (is_actionable(), F.col("start"))})

    choice = F.coalesce(F.nullif(inner(OPTION), F.lit("")), snapshot.cleaned(attr("value"), OPTION))
    chosen = F.when(attr("selected").isNotNull(), F.struct("start", inner(TEXT).alias("text")))
    options = n.where("tag = 'option' AND _select IS NOT NULL").groupBy("page_id", F.col("_select").alias("start")).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), choice.alias("text")))), lambda x: x["text"]), 1, OPTIONS).alias("options"),
        F.coalesce(F.max(chosen)["text"], F.min_by(inner(TEXT), "start")).alias("_chosen"),
    )
    s = n.where(is_selected())
    s = s.withColumn("snapshot_id", F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1)
    tag = F.col("tag")
    own = F.coalesce(F.nullif(snapshot.cleaned(F.col("own"), TEXT), F.lit("")), F.when(tag.isin("button", "a"), inner(TEXT)), F.lit(""))
    text = F.when(tag == "input", snapshot.cleaned(attr("value"), TEXT)).when(tag == "textarea", inner(TEXT)).otherwise(own)
    submits = (tag == "button") | ((tag == "input") & kind.isin("submit", "image"))
    leads = F.when(tag == "a", attr("href")).when(
        submits & F.col("_form").isNotNull(), F.coalesce(F.nullif(attr("formaction"), F.lit("")), F.nullif(F.col("_form.action"), F.lit("")), F.col("url"))
    )
    field = tag.isin("input", "textarea")
    of_field = lambda c: F.when(field, F.coalesce(c, F.lit("")))
    typed = F.when(tag == "textarea", "text").otherwise(kind)
    code = (
        F.lower(F.coalesce(attr("autocomplete"), F.lit(""))).contains("one-time-code")
        | F.lower("label").rlike(r"otp|one[\s-]?time")
        | ((attr("inputmode") == "numeric") & (attr("maxlength") == "6"))
    )
    s = s.withColumn("text", text).withColumn("target", target_of(leads, F.col("url")))
    s = s.where(tag.isin(*CONTROLS) | attr("role").isNotNull() | (F.col("text") != ""))
    s = s.select(
        "page_id", "snapshot_id", "tag", snapshot.role_of(attr("role"), tag, kind).alias("role"), "text", "label", "target.*",
        F.when(field, F.when(F.coalesce((typed != "password") & code, F.lit(False)), "otp").otherwise(typed)).alias("input_type"),
        of_field(attr("autocomplete")).alias("autocomplete"), of_field(attr("inputmode")).alias("inputmode"), of_field(attr("maxlength")).alias("maxlength"),
        snapshot.enabled(attr("disabled").isNotNull(), attr("aria-disabled")).alias("enabled"), "start", F.col("_acts").alias("acts"),
    )
    # Only what a snapshot keeps of an element meets its options: a selection is a control, and stays whatever its text.
    s = s.join(options, ["page_id", "start"], "left")
    chooses = F.col("tag") == "select"
    return s.select(
        "page_id", "snapshot_id", "tag", "role", F.when(chooses, F.coalesce("_chosen", F.lit(""))).otherwise(F.col("text")).alias("text"), "label",
        "same_origin", "target_origin", "origin_source", "input_type", "autocomplete", "inputmode", "maxlength",
        F.when(chooses, F.coalesce("options", F.array().cast("array<string>"))).alias("options"), "enabled", "start", "acts",
    )


def actionable_at(points: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds hit and acts to points (page_id, x, y): the snapshot_id of the topmost element that holds the point, and that of
    the nearest actionable element around it, or of the hit itself if none is; null where nothing is.

    elements are those of ``snapshot_of_html`` with their box; of two that hold a point, the one later in the document
    is painted over the other. Points meet the boxes of their page only.
    """
    elements = staged(elements.select("page_id", "box", "start", "snapshot_id", "acts"), "at-point-elements")
    e = elements.select(F.col("page_id").alias("_page"), "box", "start", F.struct("start", "snapshot_id", "acts").alias("_e"))
    inside = (F.col("x") >= F.col("box.x1")) & (F.col("x") < F.col("box.x2")) & (F.col("y") >= F.col("box.y1")) & (F.col("y") < F.col("box.y2"))
    top = points.join(e, (F.col("page_id") == F.col("_page")) & inside, "left").groupBy(*points.columns).agg(F.max("_e").alias("_top"))
    act = elements.select("page_id", F.col("start").alias("_acts"), F.col("snapshot_id").alias("_id"))
    top = top.withColumn("_acts", F.col("_top.acts")).join(act, ["page_id", "_acts"], "left")
    return top.select(*points.columns, F.col("_top.snapshot_id").alias("hit"), F.coalesce("_id", "_top.snapshot_id").alias("acts"))
