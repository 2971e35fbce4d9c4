"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.bind import let

#: Matches that are placed one after the other; runs of them are placed apart, so that arrays grow by short steps only.
RUN = 256
#: Characters of an entropy window; bits from which on a window is random, by class of character.
WINDOW = 20
BITS = {"hex": 3.0, "mixed": 3.6}

# The contract's patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: A candidate that one of these finds is no secret.
ALLOWED = (
    r"^[^0-9]+$",  # words without a digit
    r"^[0-9_=+/-]+$",  # numbers and rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs name things
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]",
    r"(?i)0123456789|abcdefghij",
    r"(.)\1{5}",
    r"^(?:/?[a-z0-9_-]{1,18}/)+[a-z0-9_-]{0,18}$",  # paths
)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, ord, end, s>> in code points, end exclusive."""
    kind_at = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies between matches gives their places; both lists come from the same scan order.
    between = F.split(text, pattern, -1)
    zero = F.lit(0)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,s:string>>")

    def placed(run: Column, since: Column) -> Column:
        """A short run of steps that begins at a place of the text."""

        def step(a: Column, x: Column) -> Column:
            start, end = a["at"] + x["b"], a["at"] + x["b"] + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(kind_at).alias("ord"), end.alias("end"), x["m"].alias("s"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(run, F.struct(since.alias("at"), empty.alias("out")), step)["out"]

    def walked(all_: Column) -> Column:
        runs = F.transform(F.sequence(zero, F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, RUN))
        return let(runs, lambda rs: F.flatten(F.zip_with(rs, begins(rs), placed)))

    def begins(rs: Column) -> Column:
        size = lambda run: F.aggregate(run, zero, lambda n, x: n + x["b"] + F.length(x["m"]))
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(F.transform(rs, size), start, step)["out"]

    return F.when(text.rlike(pattern), let(steps, walked)).otherwise(empty)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of s over ALPHABET; 0 if s is shorter.

    Counts of characters are kept from window to window: one goes up, one goes down, and the sum of c log2 c moves by
    the four terms that change.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    term = lambda c: F.element_at(weight, c + 1)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    # Counts are the characters of a string, one for each of ALPHABET, from "0" on.
    count = lambda c, k: F.ascii(F.substring(c, k, F.lit(1))) - 48
    put = lambda c, k, n: F.overlay(c, F.char(n + 48), k, F.lit(1))

    def step(a: Column, i: Column) -> Column:
        def fallen(x: Column) -> Column:
            """Without the character that leaves the window."""
            old = count(x["c"], x["old"])
            gone = F.struct(put(x["c"], x["old"], old - 1).alias("c"), (x["s"] - term(old) + term(old - 1)).alias("s"))
            return F.when(i > window, gone).otherwise(F.struct(x["c"].alias("c"), x["s"].alias("s")))

        def risen(x: Column) -> Column:
            new = at(i)
            up = count(x["c"], new)
            return F.struct(put(x["c"], new, up + 1).alias("c"), (x["s"] - term(up) + term(up + 1)).alias("s"))

        def seen(x: Column) -> Column:
            h = F.when(i >= window, F.greatest(a["best"], F.lit(math.log2(window)) - x["s"] / window)).otherwise(a["best"])
            return F.struct(x["c"].alias("c"), x["s"].alias("s"), h.alias("best"))

        leaves = F.greatest(F.when(i > window, at(i - window)).otherwise(F.lit(1)), F.lit(1))
        begun = F.struct(a["c"].alias("c"), a["s"].alias("s"), leaves.alias("old"))
        return let(begun, lambda x: let(fallen(x), lambda y: let(risen(y), seen)))

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.when(F.length(s) >= window, F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)["best"]).otherwise(0.0)


def is_random(s: Column) -> Column:
    """Above the threshold of its class of characters, and on no allow-list."""
    limit = F.when(s.rlike("^[0-9a-fA-F]+$"), BITS["hex"]).otherwise(BITS["mixed"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed |= s.rlike(pattern)
    return ~allowed & (window_entropy(s) >= limit)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Adds to each row of docs: base and added, arrays of struct<start, ord, end, s> in order of start, then kind.

    base holds the matches of the fixed patterns (assign with a value of 12 characters or more, access keys of 18 or
    more, hexadecimal runs of 16 or more), added the random candidate strings that lie in no base span. Positions are
    code points of the text. Null and empty texts have no spans; each row is scanned by itself, repeated or not; all
    columns of docs stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(
        matches(text, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["s"], f"^{ASSIGN}$", 1)) >= 12
    )
    access = F.filter(matches(text, ACCESS, "access"), lambda x: F.length(x["s"]) >= 18)
    found = docs.withColumn("_assign", assign).withColumn("_access", access).withColumn("_hex", matches(text, HEX, "hex"))
    found = found.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"))).drop("_access", "_hex")
    found = found.withColumn("_candidates", matches(text, CANDIDATE, "entropy"))
    # Access keys and hexadecimal runs are made of a candidate's characters, so that one touches it only from inside.
    inner = lambda c: c["s"].rlike(f"{ACCESS[:-1]}{{14}}") | c["s"].rlike(HEX)
    outside = lambda c: ~inner(c) & ~F.exists("_assign", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(F.filter("_candidates", outside), lambda c: is_random(c["s"]))
    return found.withColumn("added", F.when(F.size("_candidates") > 0, added).otherwise(F.col("_candidates"))).drop("_candidates", "_assign")


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"], x["end"])), ","
    )


def secrets_of_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = secret_spans(docs.select("doc_id", "text")).select("doc_id", "base", "added")
    count = lambda k: F.size(F.filter("base", lambda x: x["ord"] == KINDS.index(k))).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_entropy"),
    )
