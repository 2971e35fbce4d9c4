"""Plan requests as they come in: malformed ones are rejected, answers of a planner are checked, the rest goes by rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.functions.bind import let
from hushframe.functions.text import matched_terms, terms
from hushframe.operators.planner import UNDISCLOSED, request_error

ELEMENT = "struct<id:string,role:string,label:string,rect:array<int>,sensitive:boolean,same_origin:boolean,options:array<string>>"
#: answer is what a planner replied, as text; null if none was asked or none replied.
REQUEST = f"request_id bigint, goal string, safe_metadata array<{ELEMENT}>, visual_context string, answer string"
CORRUPT = "_corrupt_record"
SCHEMA = f"{REQUEST}, {CORRUPT} string"
# Limits of a request and of an answer, and why an answer is not followed.
MAX_GOAL, MAX_CONTEXT, MAX_REASON = 500, 7_100_000, 160
NO_MATCH, SCHEMA_FAILURE = "no disclosed element matches goal", "planner schema failure: "
BY_ROLE = {"textbox": ("TYPE", "goal names disclosed text field"), "combobox": ("SELECT", "goal names disclosed selection")}
CLICK = "goal terms match disclosed control"
RESPONSE = "struct<action:string,target_id:string,value:string,confidence:double,reason_code:string>"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """The fields of REQUEST from lines of JSON, and _corrupt_record: the line, if it is no such object."""
    r = F.from_json(column, SCHEMA, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    out = lines.select(r.alias("_r"), F.col(column).alias("_line"))
    # A line that is null or no object gives no struct.
    bad = F.when(F.col("_r").isNull(), F.coalesce("_line", F.lit(""))).otherwise(F.col(f"_r.{CORRUPT}"))
    return out.select(*(F.col(f"_r.{c.split()[0]}") for c in REQUEST.split(", ")), bad.alias(CORRUPT))


def rejection(df: DataFrame) -> Column:
    """422 for a request that its schema refuses, else what ``request_error`` says; null if it is fine."""
    goal, elements = F.col("goal"), F.col("safe_metadata")
    nameless = F.exists(elements, lambda e: e.isNull() | e["id"].isNull() | e["role"].isNull())
    bad = (
        F.col(CORRUPT).isNotNull()
        | goal.isNull()
        | ~F.length(goal).between(1, MAX_GOAL)
        | F.coalesce(nameless, F.lit(False))
        | F.coalesce(F.length("visual_context") > MAX_CONTEXT, F.lit(False))
    )
    return F.when(bad, 422).otherwise(request_error(F.coalesce(F.size(elements), F.lit(0)), F.col("visual_context")))


def by_rules(goal: Column, elements: Column) -> Column:
    """The rules planner's answer (RESPONSE) to one request, from its own array of elements: no join, no shuffle.

    Of the elements that may be acted on the first of the highest score wins: the matched share of the goal's terms, and
    0.15 for buttons and links. Under 0.2 the answer is STOP.
    """
    given = F.coalesce(elements, F.array().cast(f"array<{ELEMENT}>"))

    def of(words: Column) -> Column:
        def scored(e: Column, i: Column) -> Column:
            label = terms(e["label"])
            fine = ~F.coalesce(e["sensitive"], F.lit(False)) & F.coalesce(e["same_origin"], F.lit(True)) & e["role"].isin(*rules.PLANNED_ROLES) & (F.size(label) > 0)
            score = matched_terms(words, label) / F.greatest(F.lit(1), F.size(words)) + F.when(e["role"].isin("button", "link"), 0.15).otherwise(0.0)
            first = F.coalesce(F.get(e["options"], 0), F.lit(""))
            return F.when(F.coalesce(fine, F.lit(False)), F.struct(score.alias("score"), (-i).alias("at"), e["id"].alias("id"), e["role"].alias("role"), first.alias("first")))

        return F.array_max(F.filter(F.transform(given, scored), lambda s: s.isNotNull()))

    def answer(best: Column) -> Column:
        hit = F.coalesce(best["score"] >= 0.2, F.lit(False))
        sure = F.bround(F.least(F.lit(0.95), best["score"]), 2)
        says = lambda action, value, sure, reason: _response(F.lit(action), best["id"], value, sure, F.lit(reason))
        none = F.lit(None).cast("string")
        return (
            F.when(~hit, _response(F.lit("STOP"), none, none, F.lit(0.3), F.lit(NO_MATCH)))
            .when(best["role"] == "textbox", says(BY_ROLE["textbox"][0], F.lit(""), sure, BY_ROLE["textbox"][1]))
            .when(best["role"] == "combobox", says(BY_ROLE["combobox"][0], best["first"], F.least(F.lit(0.9), sure), BY_ROLE["combobox"][1]))
            .otherwise(says("CLICK", none, sure, CLICK))
        )

    return let(terms(goal), lambda words: let(of(words), answer))


def _response(action: Column, target: Column, value: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(action.alias("action"), target.alias("target_id"), value.alias("value"), confidence.alias("confidence"), reason.alias("reason_code"))


def by_answer(answer: Column) -> Column:
    """What a planner's reply says (RESPONSE): JSON, also between a pair of code fences. One that is no JSON, or no object
    of the schema, is a STOP that names its failure."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""))
    shape = "struct<action:string,target_id:string,value:string,confidence:double,reason_code:string,_bad:string>"
    said = F.from_json(bare, shape, {"columnNameOfCorruptRecord": "_bad"})
    # Numbers written as strings and the like count as the schema's types do; a field of another type makes _bad.
    json = F.try_parse_json(bare).isNotNull()
    confidence, reason = F.coalesce(said["confidence"], F.lit(0.5)), F.coalesce(said["reason_code"], F.lit("unspecified"))
    fine = said["_bad"].isNull() & F.coalesce(said["action"].isin(*rules.ACTIONS), F.lit(False)) & confidence.between(0, 1) & (F.length(reason) <= MAX_REASON)
    none = F.lit(None).cast("string")
    stop = lambda why: _response(F.lit("STOP"), none, none, F.lit(0.0), F.lit(SCHEMA_FAILURE + why))
    return (
        F.when(~json, stop("JSONDecodeError"))
        .when(~F.coalesce(fine, F.lit(False)), stop("ValidationError"))
        .otherwise(_response(said["action"], said["target_id"], said["value"], confidence, reason))
    )


def answered(requests: DataFrame) -> DataFrame:
    """request_id, source (planner or rules), and action, target_id, value, confidence, reason_code of requests that are
    fine: the planner's answer if there is one, else that of the rules; a target that was not disclosed becomes STOP.

    Works row by row, on tables as on streams.
    """
    given = F.col("answer").isNotNull()
    r = requests.withColumn("_r", F.when(given, by_answer(F.col("answer"))).otherwise(by_rules(F.col("goal"), F.col("safe_metadata"))))
    target = F.nullif(F.col("_r.target_id"), F.lit(""))
    known = F.exists(F.coalesce("safe_metadata", F.array().cast(f"array<{ELEMENT}>")), lambda e: e["id"] == target)
    none = F.lit(None).cast("string")
    stopped = _response(F.lit("STOP"), none, none, F.lit(0.0), F.lit(UNDISCLOSED))
    r = r.withColumn("_r", F.when(target.isNotNull() & ~known, stopped).otherwise(F.col("_r")))
    return r.select("request_id", F.when(given, "planner").otherwise("rules").alias("source"), "_r.*")


def audit(requests: DataFrame) -> DataFrame:
    """What may be logged of a request: request_id, goal_hash, and its numbers of elements and of image bytes."""
    return requests.select(
        "request_id", F.substring(F.sha2("goal", 256), 1, 12).alias("goal_hash"), F.coalesce(F.size("safe_metadata"), F.lit(0)).alias("elements"),
        F.coalesce(F.octet_length(F.unbase64("visual_context")), F.lit(0)).alias("image_bytes"),
    )


def split(batch: DataFrame) -> dict[str, DataFrame]:
    """A batch of parsed requests as what is answered, and what is rejected: request_id, code and the line if it was no
    request at all."""
    coded = batch.withColumn("code", rejection(batch))
    return {
        "responses": answered(coded.where("code IS NULL")),
        "rejects": coded.where("code IS NOT NULL").select("request_id", "code", F.col(CORRUPT).alias("line")),
    }

