"""The least of a page that a goal needs: scores, the crop, disclosed metadata."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.functions.bind import computed, let
from hushframe.functions.geometry import area, coverage, meets, near, rebased
from hushframe.functions.text import goal_score, terms
from hushframe.operators.spatial import first_agreement

#: Weights of relevance, actionability, confidence and sensitivity.
GOAL, ACT, CONFIDENCE, SENSITIVE = 1.2, 0.25, 0.2, 0.8


def _flag(items: DataFrame, plan: DataFrame, threshold: float, name: str) -> DataFrame:
    """Whether one plan item of the page covers more than the threshold of an item: a page's plan is one array, so that
    items are joined once."""
    masks = plan.groupBy("page_id").agg(F.collect_list("box").alias("_masks"))
    # Most boxes are apart, which four comparisons show.
    apart = (lambda m: ~meets(F.col("box"), m)) if threshold >= 0 else (lambda m: F.lit(False))
    hit = F.exists("_masks", lambda m: F.when(apart(m), False).otherwise(coverage(F.col("box"), m) > threshold))
    return items.join(masks, "page_id", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_masks")


def scored_regions(elements: DataFrame, goals: DataFrame, detections: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds relevance, actionable, confidence, sensitive and score to each element. goals: page_id, goal."""
    wanted = goals.select("page_id", terms(F.col("goal")).alias("_goal"))
    e = first_agreement(_flag(elements, plan, 0.5, "sensitive"), detections).join(wanted, "page_id")
    own = terms(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit(""))))
    e = e.withColumn("_own", own).withColumn("relevance", goal_score(F.col("_goal"), F.col("_own"))).drop("_own", "_goal")
    e = e.withColumn("actionable", F.coalesce(F.col("role").isin(*rules.ACTIONABLE), F.lit(False)))
    score = F.col("relevance") * GOAL + F.col("actionable").cast("int") * ACT + F.col("confidence") * CONFIDENCE - F.col("sensitive").cast("int") * SENSITIVE
    return e.withColumn("score", score)


def selected_context(scored: DataFrame, width: Column, height: Column, pad: int = 24, full: float = 0.88) -> DataFrame:
    """One row for each page: mode, crop, kept, considered, selected_ids, pixel_fraction and the five best regions.

    Relevant regions that are not sensitive are selected, and text that is neither sensitive, actionable nor relevant
    near one of them. Without any the mode is minimal-empty and the crop one pixel; a padded crop of over ``full`` of
    the view is the full view.
    """
    # Stable by score: relevant regions before those around them, in element order.
    label = F.substring(F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.coalesce("text", F.lit(""))), 1, 40)
    region = F.struct((-F.col("score")).alias("s"), (F.col("relevance") == 0).alias("late"), "ord", label.alias("label"), "score", "box", (F.col("relevance") > 0).alias("direct"), "actionable")

    def kept(regions: Column) -> Column:
        around = lambda direct: F.filter(regions, lambda x: x["late"] & ~x["actionable"] & F.exists(direct, lambda t: near(x["box"], t["box"])))
        return let(F.filter(regions, lambda x: x["direct"]), lambda direct: F.concat(direct, around(direct)))

    # One pass: the regions of a page are one array. Sensitive ones are counted, but not collected.
    open_ = F.collect_list(F.when(~F.col("sensitive"), region))
    out = computed(scored.groupBy("page_id").agg(F.count("*").alias("considered"), open_.alias("_open")), "_kept", kept(F.col("_open")))
    side = lambda name, pick: pick(F.transform("_kept", lambda x: x["box"][name])).alias(name)
    half_up = lambda c: F.floor(c + F.lit(0.5)).cast("int")
    out = out.select(
        "page_id", "considered",
        F.when(F.size("_kept") > 0, F.size("_kept").cast("bigint")).alias("kept"),
        side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max),
        F.array_sort(F.transform("_kept", lambda x: x["ord"])).alias("selected_ids"),
        F.slice(F.array_sort(F.transform("_kept", lambda x: F.struct(*(x[c].alias(c) for c in ("s", "late", "ord", "label", "score"))))), 1, 5).alias("_top"),
    )
    zero = F.lit(0)
    crop = F.struct(
        F.greatest(zero, half_up(F.col("x1") - pad)).alias("x1"),
        F.greatest(zero, half_up(F.col("y1") - pad)).alias("y1"),
        F.least(width, half_up(F.col("x2") + pad)).alias("x2"),
        F.least(height, half_up(F.col("y2") + pad)).alias("y2"),
    )
    whole = width.cast("bigint") * height
    out = out.withColumn("_crop", crop)
    share = area(F.col("_crop")).cast("bigint")
    mode = F.when(F.col("kept").isNull(), "minimal-empty").when(share > full * whole, "full-view").otherwise("task-roi")
    edge = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    return out.withColumn("mode", mode).select(
        "page_id",
        "mode",
        F.when(F.col("mode") == "minimal-empty", edge(zero, zero, F.lit(1), F.lit(1)))
        .when(F.col("mode") == "full-view", edge(zero, zero, width, height))
        .otherwise(F.col("_crop"))
        .alias("crop"),
        F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"),
        "considered",
        "selected_ids",
        F.when(F.col("mode") == "minimal-empty", 1 / F.greatest(F.lit(1).cast("bigint"), whole))
        .when(F.col("mode") == "full-view", F.lit(1.0))
        .otherwise(share / whole)
        .alias("pixel_fraction"),
        F.transform("_top", lambda x: F.struct(x["ord"].alias("ord"), x["label"].alias("label"), x["score"].alias("score"))).alias("top"),
    )


def safe_metadata(elements: DataFrame, plan: DataFrame, selection: DataFrame, limit: int = 60) -> DataFrame:
    """What the planner may see: selected, enabled controls in document order, at most ``limit`` of a page.

    Labels of controls that a plan item covers by over 0.35 are redacted; others are cut to 60 characters. Boxes are
    relative to the crop, which stays on the page in shot_box. Options of a control are disclosed where elements have
    a column of them, and null otherwise.
    """
    if "options" not in elements.columns:
        elements = elements.withColumn("options", F.lit(None).cast("array<string>"))
    controls = elements.where(F.col("role").isin(*rules.ACTIONABLE) & F.coalesce("enabled", F.lit(True)))
    chosen = controls.join(selection.select("page_id", "crop", "selected_ids"), "page_id").where(F.array_contains("selected_ids", F.col("ord")))
    chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("_n") <= limit)
    marked = _flag(chosen, plan, 0.35, "sensitive")
    shown = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.coalesce("text", F.lit("")))
    return marked.select(
        "page_id",
        "ord",
        F.concat(F.lit("el_"), "ord").alias("id"),
        "role",
        F.when(F.col("sensitive"), "[REDACTED]").otherwise(F.substring(shown, 1, 60)).alias("label"),
        rebased(F.col("box"), F.col("crop")).alias("box"),
        "sensitive",
        F.coalesce("same_origin", F.lit(False)).alias("same_origin"),
        "options",
        F.col("box").alias("shot_box"),
    )
