"""Scores of a whole loop: what a page discloses, what the planner does with it, and what should not have been seen."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.geometry import coverage
from hushframe.operators.metrics import masked_pixels, ratio
from hushframe.operators.requests import ELEMENT, by_rules

# Roles that a loop's metadata holds, how its target begins, and what is asked for.
ROLES, TARGET, ASKED = ("button", "link", "textbox"), "Download", " for me"


def disclosures(elements: DataFrame, plan: DataFrame, masked: float = 0.5) -> DataFrame:
    """One row for each page: goal, target (the id it should lead to) and safe_metadata, in element order.

    elements: page_id, ord, role, text, label, input_type, box. The goal asks for the page's first button whose text
    begins with Download; without one goal and target are null. Secret inputs and elements of which one plan item covers
    more than ``masked`` are left out, and all but buttons, links and text boxes. A page's plan is one array, and its
    elements another: two shuffles by page.
    """
    masks = plan.groupBy("page_id").agg(F.collect_list("box").alias("_masks"))
    name = F.concat(F.lit("el_"), F.col("ord").cast("string"))
    e = elements.join(masks, "page_id", "left")
    hidden = F.coalesce(F.exists("_masks", lambda m: coverage(F.col("box"), m) > masked), F.lit(False))
    shown = F.col("role").isin(*ROLES) & (F.coalesce("input_type", F.lit("")) == "") & ~hidden
    label = F.coalesce(F.nullif("label", F.lit("")), "text", F.lit(""))
    rect = F.array(*(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")))
    meta = F.struct(
        name.alias("id"), "role", label.alias("label"), rect.alias("rect"), F.lit(False).alias("sensitive"), F.lit(True).alias("same_origin"),
        F.lit(None).cast("array<string>").alias("options"),
    ).cast(ELEMENT)
    wanted = F.coalesce((F.col("role") == "button") & F.startswith("text", F.lit(TARGET)), F.lit(False))
    pages = e.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce(shown, F.lit(False)), F.struct("ord", meta.alias("e")))), lambda a, b: a["ord"] - b["ord"]).alias("_e"),
        F.min(F.when(wanted, F.struct("ord", name.alias("id"), "text"))).alias("_t"),
    )
    return pages.select(
        "page_id", F.concat("_t.text", F.lit(ASKED)).alias("goal"), F.col("_t.id").alias("target"), F.transform("_e", lambda x: x["e"]).alias("safe_metadata")
    )


def leaked(wire: Column, texts: Column) -> Column:
    """How many of an array of texts (repeats count, empty ones don't) stand somewhere in the wire's JSON."""
    return F.size(F.filter(texts, lambda t: (F.coalesce(t, F.lit("")) != "") & F.contains(wire, t)))


def loop_scores(pages: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """By set: pages, planning_success (the share in which the planner clicks the target), pii_strings_in_metadata (gold
    texts that stand in what was sent), and the secret fields that were found of those that there are.

    pages: those of ``disclosures`` with ``by``, secrets_found and secrets_expected; gold: page_id, text. A page without
    a target is none that succeeded. A request goes through the rules, whose targets are always disclosed.
    """
    texts = gold.groupBy("page_id").agg(F.collect_list("text").alias("_gold"))
    p = pages.join(texts, "page_id", "left").withColumn("_r", by_rules(F.col("goal"), F.col("safe_metadata")))
    ok = F.coalesce((F.col("_r.action") == "CLICK") & (F.col("_r.target_id") == F.col("target")), F.lit(False))
    wire = F.to_json(F.struct("goal", "safe_metadata"))
    p = p.withColumn("_ok", ok.cast("int")).withColumn("_leaks", F.coalesce(leaked(wire, F.coalesce("_gold", F.array().cast("array<string>"))), F.lit(0)))
    out = p.groupBy(by).agg(
        F.count("*").alias("pages"), F.sum("_ok").alias("_ok"), F.sum("_leaks").alias("pii_strings_in_metadata"),
        F.sum("secrets_found").alias("secret_fields_found"), F.sum("secrets_expected").alias("secret_fields_expected"),
    )
    return out.select(by, "pages", ratio(F.col("_ok"), F.col("pages")).alias("planning_success"), "pii_strings_in_metadata", "secret_fields_found", "secret_fields_expected")


def overmasked(pages: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """By set the pixels that masks cover beyond what is sensitive, and what percentage of all pixels they are.

    pages: page_id, by, masks and sensitive (arrays of boxes)."""
    px = masked_pixels(pages, width, height).groupBy(by).agg(F.count("*").alias("pages"), F.sum(F.col("mask_px") - F.col("both_px")).alias("over_px"))
    return px.withColumn("overmask_pct", ratio(F.col("over_px") * 100, F.col("pages") * (width * height)))


def first_pages(pages: DataFrame, k: int, page: str = "page_id") -> DataFrame:
    """The rows of the first k pages by id, all rows of each."""
    return pages.join(F.broadcast(pages.select(page).distinct().orderBy(page).limit(k)), page, "left_semi")
