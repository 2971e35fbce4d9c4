"""The rules planner, request checks, the action gate, and checks before and after an action."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.functions.text import alike, matched_terms, terms

MAX_ELEMENTS, MAX_IMAGE = 100, 5 << 20
PNG = "89504E470D0A1A0A"


def request_error(n_elements: Column, visual_context: Column) -> Column:
    """413 for over 100 elements or 5 MiB of image, 422 for bad Base64 or no PNG; null if the request is fine."""
    given = F.coalesce(visual_context, F.lit("")) != ""
    raw = F.when(visual_context.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(visual_context))
    return (
        F.when(n_elements > MAX_ELEMENTS, 413)
        .when(given & raw.isNull(), 422)
        .when(given & (F.octet_length(raw) > MAX_IMAGE), 413)
        .when(given & ~F.hex(raw).startswith(PNG), 422)
    )


def plan_rules(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """One action for each request (request_id, goal) over its elements (request_id, ord, id, role, label, sensitive,
    same_origin, options).

    A candidate scores the matched share of goal terms, and 0.15 more for buttons and links; the first of the best
    wins if it has 0.2 or more, otherwise the action is STOP.
    """
    goal = requests.select("request_id", terms(F.col("goal")).alias("goal"))
    fine = ~F.coalesce("sensitive", F.lit(False)) & F.coalesce("same_origin", F.lit(False)) & F.col("role").isin(*rules.PLANNED_ROLES)
    c = elements.where(fine).withColumn("words", terms(F.col("label"))).where(F.size("words") > 0).join(goal, "request_id")
    score = matched_terms(F.col("goal"), F.col("words")) / F.greatest(F.lit(1), F.size("goal")) + F.when(F.col("role").isin("button", "link"), 0.15).otherwise(0.0)
    best = (
        c.withColumn("score", score)
        .where("score > 0")
        .groupBy("request_id")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "id", "role", "options")).alias("b"))
    )
    r = requests.select("request_id").join(best, "request_id", "left").withColumn("hit", F.coalesce(-F.col("b.s") >= 0.2, F.lit(False)))
    sure = F.bround(F.least(F.lit(0.95), -F.col("b.s")), 2)
    action = F.when(~F.col("hit"), "STOP").when(F.col("b.role") == "textbox", "TYPE").when(F.col("b.role") == "combobox", "SELECT").otherwise("CLICK")
    return r.withColumn("action", action).select(
        "request_id",
        "action",
        F.when(F.col("hit"), F.col("b.id")).alias("target_id"),
        F.when(F.col("action") == "TYPE", "").when(F.col("action") == "SELECT", F.coalesce(F.get(F.col("b.options"), 0), F.lit(""))).alias("value"),
        F.when(~F.col("hit"), 0.3).when(F.col("action") == "SELECT", F.least(F.lit(0.9), sure)).otherwise(sure).alias("confidence"),
        F.when(~F.col("hit"), "no disclosed element matches goal")
        .when(F.col("action") == "TYPE", "goal names disclosed text field")
        .when(F.col("action") == "SELECT", "goal names disclosed selection")
        .otherwise("goal terms match disclosed control")
        .alias("reason_code"),
    )


#: Fixed value: the reason of an action that was stopped for its target.
UNDISCLOSED = "planner targeted undisclosed element"


def undisclosed_to_stop(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Actions on a target that was not disclosed become STOP, sure of nothing, without target and value.

    actions: request_id, target_id, action, and of confidence, value and reason_code what there is. An empty target is
    none.
    """
    known = elements.select("request_id", F.col("id").alias("target_id"), F.lit(True).alias("_known")).distinct()
    bad = (F.coalesce("target_id", F.lit("")) != "") & F.col("_known").isNull()
    fresh = {"action": "STOP", "confidence": 0.0, "reason_code": UNDISCLOSED, "target_id": None, "value": None}
    a = actions.join(known, ["request_id", "target_id"], "left").withColumn("_bad", bad)
    stopped = [F.when(F.col("_bad"), F.lit(fresh[c])).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in actions.columns]
    return a.select(*stopped)


def with_target(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds found, sensitive and same_origin of the disclosed element (request_id, id) that target_id names; found is false
    and the others null where none is. Elements that repeat an id count once, by the first in order of ord."""
    known = elements.groupBy("request_id", F.col("id").alias("target_id")).agg(F.min_by(F.struct("sensitive", "same_origin"), "ord").alias("_t"))
    a = actions.join(known, ["request_id", "target_id"], "left")
    return a.select(*actions.columns, F.col("_t").isNotNull().alias("found"), "_t.sensitive", "_t.same_origin")


# The reasons below are fixed values.
def intent_note(goal: Column, target: Column) -> Column:
    """goal and target are arrays of terms."""
    hit = F.exists(goal, lambda g: F.exists(target, lambda t: alike(g, t)))
    return (
        F.when(F.size(goal) == 0, "goal has no actionable terms")
        .when(F.size(target) == 0, "target has no safe label")
        .when(hit, "goal term matches target label")
        .otherwise("no goal term matches target label")
    )


def gate(action: Column, found: Column, sensitive: Column, same_origin: Column, note: Column) -> Column:
    """struct<verdict, reason>: the first reason to block; else CONFIRM for R2 actions; else ALLOW."""
    says = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    tier = F.lit(None).cast("string")
    for name, level in rules.RISK.items():
        tier = F.when(action == name, level).otherwise(tier)
    return (
        F.when(action.isNull(), says("BLOCK", "planner returned no object"))
        .when(~action.isin(*rules.ACTIONS), says("BLOCK", F.concat(F.lit("unsupported action: "), action)))
        .when(~action.isin(*rules.NEEDS_TARGET), says("ALLOW", F.concat(action, F.lit(" needs no target"))))
        .when(~F.coalesce(found, F.lit(False)), says("BLOCK", "target_id is outside disclosed metadata"))
        .when(F.coalesce(sensitive, F.lit(False)), says("BLOCK", "target overlaps a redacted region"))
        .when(~F.coalesce(same_origin, F.lit(False)), says("BLOCK", "target origin is cross-origin or unresolved"))
        .when(note != "goal term matches target label", says("BLOCK", F.concat(F.lit("intent check: "), note)))
        .when(tier == "R2", says("CONFIRM", "state-changing input action"))
        .otherwise(says("ALLOW", F.concat(F.lit("risk "), tier)))
    )


def stale_reason(expected: Column, probe: Column) -> Column:
    """Why a target is not what it was, or null.

    expected is struct<role, label, same_origin>, of which a null field expects nothing; probe is what is now at the
    target's centre, struct<role, label, same_origin, enabled>, or null.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    a, b = low(expected["label"]), low(probe["label"])
    return (
        F.when(probe.isNull(), "no element at target point")
        .when(~F.coalesce(probe["enabled"], F.lit(True)), "target is disabled")
        .when((F.coalesce(expected["role"], F.lit("")) != "") & ~expected["role"].eqNullSafe(probe["role"]), "target role changed")
        .when((a != "") & ~(F.contains(b, a) | F.contains(a, b)), "target label changed")
        .when(expected["same_origin"].isNotNull() & ~expected["same_origin"].eqNullSafe(probe["same_origin"]), "target origin changed")
    )


def verified(before: Column, after: Column, downloads: Column) -> Column:
    """Whether anything shows that the action worked: a download, or a new address, title, height, text or scroll."""
    moved = lambda n: ~before[n].eqNullSafe(after[n])
    return (
        (F.coalesce(downloads, F.lit(0)) > 0)
        | moved("url")
        | moved("title")
        | moved("height")
        | F.coalesce(F.abs(before["text_length"] - after["text_length"]) > 5, F.lit(False))
        | moved("scroll_y")
    )


def allowed_endpoint(url: Column, hosts=("127.0.0.1", "localhost"), port: str = "8000", path: str = "/plan") -> Column:
    """Plain HTTP to this machine's planner and nothing else."""
    return F.coalesce(url.rlike(f"^http://(?:{'|'.join(h.replace('.', '[.]') for h in hosts)}):{port}{path}$"), F.lit(False))
