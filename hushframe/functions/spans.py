"""Spans and redaction of whole columns of long texts, in steps: time grows with the length of a text and its matches.

``functions.text`` has the same as single expressions, for short texts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.functions.bind import let
from hushframe.functions.checksum import verhoeff_ok
from hushframe.functions.runs import before_each, runs_of
from hushframe.functions.shadow import shadow
from hushframe.functions.text import SPAN


def _steps(shade: Column, pattern: str) -> Column:
    """For each match what lies between it and the one before, and its length. Texts without one are read once."""
    found, between = F.regexp_extract_all(shade, F.lit(pattern), F.lit(0)), F.split(shade, pattern, -1)
    each = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
    # One piece more than there are matches lies between them.
    there = shade.rlike(pattern)
    if pattern in rules.NEEDS:
        there = shade.rlike(rules.NEEDS[pattern]) & there
    return F.when(there, F.filter(each, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,size:int>>"))


def _length(run: Column) -> Column:
    return F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])


def _placed(text: Column, run: Column, since: Column, cls: str) -> Column:
    """The spans of a run that begins at a place of the text; their own texts come from the stretch that it covers."""

    def of(stretch: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start, end = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
            own = F.substring(stretch, start + 1, x["size"])
            span = F.struct(F.lit(cls).alias("cls"), (since + start).alias("start"), (since + end).alias("end"), own.alias("text"))
            return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

        return F.aggregate(run, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step)["out"]

    return let(F.substring(text, since + 1, _length(run)), of)


def with_matches(df: DataFrame, column: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds arrays of spans: patterns has by name the class and the pattern. Matches don't overlap and come from left to
    right; positions are code points, end exclusive. The shadow of a text is made once for all patterns."""
    df = df.withColumn("_shade", shadow(F.col(column)))
    df = df.withColumns({f"_{n}_steps": _steps(F.col("_shade"), p) for n, (_, p) in patterns.items()})
    df = df.withColumns({f"_{n}_runs": runs_of(F.col(f"_{n}_steps")) for n in patterns})
    place = lambda cls: lambda run, since: _placed(F.col(column), run, since, cls)
    found = {n: F.flatten(F.zip_with(F.col(f"_{n}_runs"), before_each(F.col(f"_{n}_runs"), _length), place(cls))) for n, (cls, _) in patterns.items()}
    return df.withColumns(found).drop("_shade", *(f"_{n}_{x}" for n in patterns for x in ("steps", "runs")))


def with_spans(df: DataFrame, column: str, name: str, profile: str = "text", labelled: str | None = None) -> DataFrame:
    """Adds the spans of all the profile's shapes, those of the column ``labelled`` first, in order of start.

    Twelve digits count as AADHAAR only with a valid checksum and as an account number only without one. A span is
    dropped if its start lies in one of a shape before it (or a labelled one) that was kept.
    """
    formats = rules.FORMATS[profile]
    df = with_matches(df, column, {f"_{name}_{cls}": (cls, pattern) for cls, pattern in formats})
    groups = [F.col(labelled)] if labelled else []
    for cls, _ in formats:
        spans = F.col(f"_{name}_{cls}")
        if cls == "AADHAAR":
            spans = F.filter(spans, lambda x: verhoeff_ok(x["text"]))
        if cls == "ACCOUNT":
            spans = F.filter(spans, lambda x: ~verhoeff_ok(x["text"]))
        groups.append(spans)
    rank = lambda r: lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), s.alias("span"))
    ranked = [F.transform(g, rank(r)) for r, g in enumerate(groups)]
    df = df.withColumn(f"_{name}_all", F.array_sort(F.concat(*ranked)))
    df = df.withColumn(name, claimed(F.col(f"_{name}_all"), len(groups)))
    return df.drop(f"_{name}_all", *(f"_{name}_{cls}" for cls, _ in formats))


def claimed(ranked: Column, ranks: int) -> Column:
    """Of spans in order of start, then rank, those whose start lies in no kept span of a lower rank.

    One walk: what may drop a span has been met by then. How far the kept spans of each rank reach goes along; what
    stays is gathered run by run.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, x: Column) -> Column:
        free = F.forall(F.slice(a["reach"], 1, x["rank"]), lambda end: end <= x["start"])
        reach = F.transform(a["reach"], lambda end, k: F.when(k == x["rank"], F.greatest(end, x["span"]["end"])).otherwise(end))
        return F.when(free, F.struct(reach.alias("reach"), F.array_append(a["out"], x["span"]).alias("out"))).otherwise(a)

    def walked(state: Column, run: Column) -> Column:
        done = F.aggregate(run, F.struct(state["reach"].alias("reach"), none.alias("out")), step)
        return let(done, lambda d: F.struct(d["reach"].alias("reach"), F.array_append(state["runs"], d["out"]).alias("runs")))

    start = F.struct(F.array_repeat(F.lit(0), ranks).alias("reach"), F.array().cast(f"array<array<{SPAN}>>").alias("runs"))
    return F.flatten(F.aggregate(runs_of(ranked), start, walked)["runs"])


def with_splice(df: DataFrame, column: str, tokens: Column, name: str) -> DataFrame:
    """Adds the text with each span replaced by its token; a span that begins before the last one's end is skipped.

    tokens: array of struct<start, end, token>. Runs of spans are written one after the other, each from the stretch of
    text that it covers.
    """
    text, spans = F.col(column), F.col(f"_{name}_spans")

    def written(state: Column, run: Column) -> Column:
        upto = F.greatest(state["at"], F.array_max(F.transform(run, lambda x: x["end"])))

        def of(stretch: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                gap = F.substring(stretch, a["at"] - state["at"] + 1, x["start"] - a["at"])
                taken = F.struct(x["end"].alias("at"), F.concat(a["out"], gap, x["token"]).alias("out"))
                return F.when(x["start"] < a["at"], a).otherwise(taken)

            return F.aggregate(run, F.struct(state["at"].alias("at"), F.lit("").alias("out")), step)

        piece = let(F.substring(text, state["at"] + 1, upto - state["at"]), of)
        return let(piece, lambda p: F.struct(p["at"].alias("at"), F.array_append(state["out"], p["out"]).alias("out")))

    df = df.withColumn(f"_{name}_spans", F.array_sort(tokens))
    done = F.aggregate(runs_of(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), written)
    df = df.withColumn(f"_{name}_done", done)
    d = F.col(f"_{name}_done")
    out = F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return df.withColumn(name, out).drop(f"_{name}_spans", f"_{name}_done")


def tokens(spans: Column, end: str = "_1]") -> Column:
    """Spans of class C become [C_1]."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), x["cls"], F.lit(end)).alias("token")))


def redacted(df: DataFrame, column: str, name: str, profile: str = "text") -> DataFrame:
    """Adds the text with the profile's shapes redacted."""
    df = with_spans(df, column, f"_{name}_found", profile)
    return with_splice(df, column, tokens(F.col(f"_{name}_found")), name).drop(f"_{name}_found")
