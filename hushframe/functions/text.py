"""Classes of values, spans, redaction and terms, as column expressions. Texts are matched on their ASCII shadow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rules
from hushframe.functions.bind import let
from hushframe.functions.checksum import verhoeff_ok
from hushframe.functions.shadow import shadow

SPAN = "struct<cls:string,start:int,end:int,text:string>"


def label_hint(label: Column, profile: str) -> Column:
    """The first class one of whose hints is in the lower-cased label; null if none is."""
    return let(F.lower(F.coalesce(label, F.lit(""))), lambda low: _hint(low, profile))


def _hint(low: Column, profile: str) -> Column:
    hint = F.lit(None).cast("string")
    for cls, words in reversed(rules.HINTS[profile]):
        found = F.lit(False)
        for w in words:
            found |= F.contains(low, F.lit(w))
        hint = F.when(found, cls).otherwise(hint)
    return hint


def classify(value: Column, label: Column, profile: str = "runtime") -> Column:
    """The class of a labelled value.

    A class that the label names wins if the value has its shape; otherwise the first shape that the value has (an
    account number neither if it is a valid AADHAAR number nor under another class's label); then a bare name under
    a person's label; then the label's class alone, but for persons and accounts. Blank values have none.
    """
    both = F.struct(F.trim(shadow(F.coalesce(value, F.lit("")))).alias("t"), label_hint(label, profile).alias("hint"))
    return let(both, lambda x: _class(x["t"], x["hint"], profile))


def _class(t: Column, hint: Column, profile: str) -> Column:
    # An expression in a lambda is evaluated wherever it stands: a null hint must not ask for each shape, and most
    # texts have nothing that a shape could be of.
    found = {cls: F.regexp_extract(t, pattern, 0) for cls, pattern in rules.FORMATS[profile]}
    has = {cls: (m != "") for cls, m in found.items()}
    has["AADHAAR"] = has["AADHAAR"] & verhoeff_ok(found["AADHAAR"])
    agreed = F.lit(False)
    for cls, there in has.items():
        agreed |= hint.eqNullSafe(cls) & there
    has["ACCOUNT"] = has["ACCOUNT"] & ~verhoeff_ok(found["ACCOUNT"]) & (hint.isNull() | (hint == "ACCOUNT"))
    shape = F.when(t.rlike(rules.SHAPED), F.coalesce(*(F.when(there, cls) for cls, there in has.items())))
    alone = F.when(
        (hint == "PERSON") & t.rlike(f"^{rules.NAME.replace(chr(92) + 'b', '')}$"), F.lit("PERSON")
    ).when(~hint.isin("PERSON", "ACCOUNT"), hint)
    return F.when(t == "", None).when(hint.isNotNull() & agreed, hint).otherwise(F.coalesce(shape, alone))


def spans_of(text: Column, pattern: str, cls: str) -> Column:
    """Non-overlapping matches from left to right; positions in code points, end exclusive, text from the original."""
    def sizes_in(s: Column) -> Column:
        # One piece more than there are matches lies between them.
        found, between = F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(s, pattern, -1)
        each = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
        return F.filter(each, lambda x: x["size"].isNotNull())

    sizes = let(shadow(text), sizes_in)
    walked = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end")))
            ).alias("out"),
        ),
    )["out"]
    return F.transform(
        walked,
        lambda x: F.struct(
            F.lit(cls).alias("cls"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text"),
        ),
    )


def claim(candidates: Column) -> Column:
    """Spans in order of claim; one is dropped if its start lies in a span before it, or it is the same."""
    return F.aggregate(
        candidates,
        F.array().cast(f"array<{SPAN}>"),
        lambda kept, x: F.when(
            F.exists(kept, lambda k: (k["start"] <= x["start"]) & (x["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def detect_spans(text: Column, profile: str = "text", labelled: Column | None = None) -> Column:
    """All spans of the profile's shapes, labelled ones first, sorted by start.

    Twelve digits count as AADHAAR only with a valid checksum and as an account number only without one.
    """
    each = []
    for cls, pattern in rules.FORMATS[profile]:
        spans = spans_of(text, pattern, cls)
        if cls == "AADHAAR":
            spans = F.filter(spans, lambda x: verhoeff_ok(x["text"]))
        if cls == "ACCOUNT":
            spans = F.filter(spans, lambda x: ~verhoeff_ok(x["text"]))
        each.append(spans)
    if labelled is not None:
        each.insert(0, labelled)
    return F.array_sort(
        claim(F.concat(*each)),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
    )


def splice(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its token; a span that begins before the last one's end is skipped.

    spans: array of struct<start, end, token>.
    """
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["token"]).alias("out"),
            )
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def redact(text: Column, spans: Column) -> Column:
    """Spans of class C become [C_1]."""
    return splice(
        text,
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), x["cls"], F.lit("_1]")).alias("token"))),
    )


def tokenised(df: DataFrame, column: str, profile: str = "browser") -> DataFrame:
    """df with each match of each shape in the column, in the profile's order, as [CLASS_n], n counted by class from
    left to right. One projection for each class, as each looks at what the one before it has written."""
    for cls, pattern in rules.FORMATS[profile]:
        df = df.withColumn(column, _numbered(F.col(column), cls, pattern))
    return df


def _numbered(text: Column, cls: str, pattern: str) -> Column:
    spans = spans_of(text, pattern, cls)
    if cls == "AADHAAR":
        spans = F.filter(spans, lambda x: verhoeff_ok(x["text"]))

    def token(x: Column, i: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit(f"[{cls}_"), i + 1, F.lit("]")).alias("token"))

    return let(spans, lambda found: F.when(F.size(found) > 0, splice(text, F.transform(found, token))).otherwise(text))


def contextual_spans(text: Column, profile: str = "runtime") -> Column:
    """Addresses in free text; where there are none, names that are not on the profile's list."""
    # An address has a number in it.
    addresses = F.when(text.rlike("[0-9]"), spans_of(text, rules.ADDRESS, "ADDRESS"))
    names = F.filter(spans_of(text, rules.NAME, "PERSON"), lambda x: ~x["text"].isin(*rules.NOT_NAMES[profile]))
    long = F.length(text) >= rules.FREE_TEXT[profile]
    found = F.when(F.size(addresses) > 0, addresses).otherwise(names)
    return F.when(long, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of over two characters that are no stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1)
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(*rules.STOP_WORDS))


def alike(a: Column, b: Column) -> Column:
    """Equal, or one begins the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def matched_terms(goal: Column, label: Column) -> Column:
    """How many goal terms (repeats count) are like some label term; both are arrays."""
    return F.size(F.filter(goal, lambda g: F.exists(label, lambda w: alike(w, g))))


def goal_score(goal: Column, label: Column) -> Column:
    """Matched goal terms over all goal terms; 0 without any."""
    return F.coalesce(F.try_divide(matched_terms(goal, label), F.size(goal)), F.lit(0.0))
