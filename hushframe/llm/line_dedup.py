"""Line dedup: a segment-partition edit join of distinct lines, and removal of all but the first line of a class.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.bind import computed
from hushframe.llm.shared import Bitmap, components, discard, joined, staged

#: Edits (insertions, deletions, substitutions of a code point) within which lines link.
EDITS = 2
#: Code points of a segment that its signature looks at: lines that agree in a segment agree in its beginning.
SIGNED = 32
#: Letters whose counts, modulo 4, make up the sketch of a line; the bits from 30 on tell how it is looked up.
LETTERS = "entairsohdlugwb"
#: Code points of a line from which on it can be a duplicate: every line that is not blank.
LEAST = 1
#: Code points of the longer of two lines from which on edits link them: among shorter ones ("Yes.", "Yet.") two edits
#: make other words. Equal lines are duplicates at any length.
LINKED = 25


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (1-based) and size of segment i of edits + 1; the later segments get what doesn't divide."""
    base, long = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    short = edits + 1 - long
    extra = F.greatest(F.lit(i) - short, F.lit(0))
    return F.lit(1) + base * i + extra, base + (F.lit(i) >= short).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(lengths less, segment, shift) of the substrings that a line looks up, by the multi-match-aware windows.

    For a line that is ``less`` longer than the indexed one, segment i can have shifted by at most i edits before it,
    and by at most edits - i after it.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            lo, hi = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(lo, hi + 1)]
    return out


def _signature(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start, F.least(size, F.lit(SIGNED))))


#: Common beginnings and ends are cut off in powers of two from the first of these down to the last, each at most once:
#: together they reach over lines shorter than twice the first. Longer lines begin with the powers of LONG_CUTS, which
#: reach over any string.
CUTS = tuple(1 << x for x in range(12, 2, -1))
LONG_CUTS = tuple(1 << x for x in range(30, 12, -1)) + CUTS


def _trimmed(a: Column, b: Column) -> Column:
    """struct<ahead, behind>: code points of a common beginning and end, all of them but up to 7."""
    n_a, n_b = F.length(a), F.length(b)
    short, long = (F.array(*map(F.lit, cuts)) for cuts in (CUTS, LONG_CUTS))

    def common(most: Column, same) -> Column:
        steps = F.when(most < 2 * CUTS[0], short).otherwise(long)
        return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= most) & same(p, s), p + s).otherwise(p))

    ahead = common(F.least(n_a, n_b), lambda p, s: F.substring(a, p + 1, s) == F.substring(b, p + 1, s))

    def ends(p: Column) -> Column:
        behind = common(
            F.least(n_a, n_b) - p, lambda q, s: F.substring(a, n_a - q - s + 1, s) == F.substring(b, n_b - q - s + 1, s)
        )
        return F.struct(p.alias("ahead"), behind.alias("behind"))

    return F.transform(F.array(ahead), ends)[0]


def may_be_within(a: Column, b: Column, edits: int) -> Column:
    """False only if a and b are over ``edits`` edits apart: a screen by a few comparisons of whole pieces.

    Where a common beginning and end are cut off, the first and the last edit stand within a few code points of the
    ends of what is left. What lies between them has at most edits - 2 more, so that of so many pieces and one more
    one stands unchanged in the other line, moved by less than ``edits``.
    """
    slack, n_pieces = 2 * CUTS[-1] + edits, max(1, edits - 1)

    def between(x: Column) -> Column:
        start, size = x["ahead"] + slack, F.length(a) - x["ahead"] - x["behind"] - 2 * slack
        piece = F.floor(size / n_pieces).cast("int")
        found = size < n_pieces
        for i in range(n_pieces):
            at = start + piece * i
            for shift in range(-(edits - 1), edits):
                found |= F.substring(a, at + 1, piece) == F.substring(b, at + 1 + shift, piece)
        return found

    return F.transform(F.array(_trimmed(a, b)), between)[0]


def edit_distance_within(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of a and b if it is at most ``edits``; otherwise some larger number.

    A bit-parallel computation in a diagonal band: for each code point of b, the vertical differences of 2 edits + 1
    rows around the diagonal are two bit vectors, moved down one row a step; the score follows the band's lowest
    diagonal until it meets a's last row, and then that row. Common beginnings and ends are cut off before.
    """
    n_a, n_b = F.length(a), F.length(b)

    def rest(x: Column) -> Column:
        off = x["ahead"] + x["behind"]
        cut = lambda s, n: F.split(F.substring(s, x["ahead"] + 1, n - off), "")
        return F.struct(cut(a, n_a).alias("a"), cut(b, n_b).alias("b"), (n_a - off).alias("m"), (n_b - off).alias("n"))

    both = F.transform(F.array(_trimmed(a, b)), rest)
    return F.transform(both, lambda x: _banded(x, edits))[0]


def _banded(x: Column, k: int) -> Column:
    """Of x.m code points x.a and x.n code points x.b."""
    width = 2 * k + 1
    full = (1 << width) - 1
    one = lambda v: F.lit(v).cast("bigint")
    keep = lambda v: v.bitwiseAND(one(full))
    inverse = lambda v: v.bitwiseXOR(one(full))
    bit = lambda v, at: F.expr("1L").bitwiseAND(F.call_function("shiftright", v, at)) == 1

    def step(s: Column, j: Column) -> Column:
        c = F.get(x["b"], j - 1)
        rows = one(0)
        for at in range(width):  # row j - k + at of a, 1-based
            same = (j - k + at >= 1) & (F.get(x["a"], F.greatest(j - k + at - 1, F.lit(0))) == c)
            rows = rows + F.when(F.coalesce(same, F.lit(False)), one(1 << at)).otherwise(one(0))

        def columns(e: Column) -> Column:
            equal, vp, vn = e["equal"], e["vp"], e["vn"]
            d0 = keep((equal.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(equal).bitwiseOR(vn)
            return F.transform(F.array(F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"))), horizontal)[0]

        def horizontal(e: Column) -> Column:
            hp = e["vn"].bitwiseOR(inverse(e["d0"].bitwiseOR(e["vp"])))
            hn = e["d0"].bitwiseAND(e["vp"])
            return F.transform(F.array(F.struct(e["d0"].alias("d0"), hp.alias("hp"), hn.alias("hn"))), vertical)[0]

        def vertical(e: Column) -> Column:
            down = F.shiftright(e["d0"], 1)
            at = x["m"] - j + k
            score = (
                F.when(j <= x["m"] - k, s["d"] + (~bit(e["d0"], F.lit(2 * k))).cast("int"))
                .when((at >= 0) & (at < width), s["d"] + bit(e["hp"], at).cast("int") - bit(e["hn"], at).cast("int"))
                .otherwise(s["d"] + 1)
            )
            return F.struct(
                e["hn"].bitwiseOR(inverse(down.bitwiseOR(e["hp"]))).alias("vp"),
                down.bitwiseAND(e["hp"]).alias("vn"),
                score.alias("d"),
            )

        return F.transform(F.array(F.struct(rows.alias("equal"), s["vp"].alias("vp"), s["vn"].alias("vn"))), columns)[0]

    # Before the first column: rows above the text are no rise, those below it one each.
    start = F.struct(one(full - (1 << k) + 1).alias("vp"), one(0).alias("vn"), F.least(F.lit(k), x["m"]).alias("d"))
    walked = F.aggregate(F.sequence(F.lit(1), x["n"]), start, step)["d"]
    return F.when(F.abs(x["m"] - x["n"]) > k, F.lit(k + 1)).when(x["n"] <= 0, x["m"]).when(x["m"] <= 0, x["n"]).otherwise(walked)


def sketch(line: Column) -> Column:
    """Counts of LETTERS, two bits each. A letter that is counted is taken out, so that the next has less to look at."""
    out, rest = F.lit(0), line
    for k, letter in enumerate(LETTERS):
        others = F.replace(rest, F.lit(letter))
        n = F.octet_length(rest) - F.octet_length(others)
        out, rest = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(3)), 2 * k)), others
    return out


def sketches_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of the counts.

    A substitution changes that sum by at most 2, an insertion or deletion by 1: two lines within e edits whose
    lengths differ by n are at most 2 e - n apart.
    """
    out = F.lit(0)
    for k in range(len(LETTERS)):
        count = lambda v: F.shiftrightunsigned(v, 2 * k).bitwiseAND(F.lit(3))  # noqa: B023, E731
        d = (count(a) - count(b)).bitwiseAND(F.lit(3))
        out = out + F.least(d, F.lit(4) - d)
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """doc (a hash of doc_id and text), doc_id, at (0-based), line, and two hashes of it, node and check, of each line
    that is not blank."""
    each = docs.where(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("doc"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
    )
    each = each.where((F.length("line") >= LEAST) & F.col("line").rlike(r"\S"))
    return each.withColumn("node", F.xxhash64("line")).withColumn("check", F.xxhash64(F.lit(LEAST), "line"))


def edit_links(lines: DataFrame, edits: int = EDITS, repeated: DataFrame | None = None) -> DataFrame:
    """Links (a < b) between the nodes of lines (node, line) that are within ``edits`` edits, the longer of LINKED or more.

    Each distinct line is indexed under its length and each of its edits + 1 segments, of which at least one stands
    unchanged in any line within reach, and looks up the substrings where such a segment can be; both are hashes. What
    it would look up in place, under its own length, it is indexed under, so that the index also meets itself. Where
    hashes meet, letter counts screen the pair before it is formed, so that versions of a line that share whole
    segments do not become all their pairs; what is left is verified on the lines.

    Texts hardly cross the network. Lines that stand in one place only are read where they lie; those that
    ``repeated`` (node; found in lines if not given) holds are brought together first. Of the candidates' texts, too,
    only what a bitmap of their nodes lets through is sent.
    """
    if repeated is None:
        repeated = staged(lines.groupBy("node").count().where("count > 1").select("node"), "lines-repeated")
    lines = lines.where(F.length("line") >= LINKED - edits).select("node", "line")
    often = Bitmap(repeated.select("node"), "lines-repeated-bits").marked(lines, "node", "often")
    distinct = often.where("NOT often").select("node", "line").union(often.where("often").select("node", "line").distinct())
    n = F.col("n")
    # The length stands in each signature several times.
    sized = computed(distinct, "n", F.length("line"))
    index, lookups = [], []
    for i in range(edits + 1):
        start, size = _segment(n, i, edits)
        index.append(_signature(F.col("line"), n, i, start, size).alias(f"i{i}"))
    sought = [(less, i, shift) for less, i, shift in probes(edits) if less or shift]
    for k, (less, i, shift) in enumerate(sought):
        start, size = _segment(n - less, i, edits)
        sig = _signature(F.col("line"), n - less, i, start + shift, size)
        # The line that looks up is the longer one; the first says so, as parts of a condition would be computed anew in each.
        lookups.append((sig if k else F.when(n >= LINKED, sig)).alias(f"l{k}"))
    # Letters are counted once: that costs more than to write the numbers down.
    signed = staged(sized.select("node", sketch(F.col("line")).alias("s"), *index, *lookups), "lines-signed")
    index = signed.select("node", "s", F.explode(F.array(*(f"i{i}" for i in range(edits + 1)))).alias("sig"))
    # less (3: 3 or more) stands above the sketch.
    code = lambda less: F.col("s").bitwiseOR(F.shiftleft(F.lit(min(less, 3)), 30)).alias("s")
    lookups = F.array(*(F.struct(code(less), F.col(f"l{k}").alias("sig")) for k, (less, _, _) in enumerate(sought)))
    lookups = signed.where("l0 IS NOT NULL").select("node", F.inline(lookups))
    side = lambda df, x: df.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"), F.col("sig"))
    apart, less = sketches_apart(F.col("sa"), F.col("sb")), F.shiftrightunsigned("sb", 30)
    left, right = side(index, "a"), side(index, "b")
    met = left.join(right, (left["sig"] == right["sig"]) & (F.col("a") < F.col("b")) & (apart <= 2 * edits)).select("a", "b")
    right = side(lookups, "b")
    near = (left["sig"] == right["sig"]) & (F.col("a") != F.col("b")) & (apart <= 2 * edits - less)
    met = met.union(left.join(right, near).select(F.least("a", "b"), F.greatest("a", "b")))
    met = staged(met.distinct(), "lines-met")
    discard(signed)

    ends = met.select(F.col("a").alias("node")).union(met.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    ends = staged(ends, "lines-ends")
    texts = Bitmap(ends.select("node"), "lines-ends-bits").marked(lines, "node", "there").where("there")
    texts = staged(texts.select("node", "line").distinct().join(ends, "node"), "lines-texts")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"l{x}"), "n")
    full = joined(joined(met, text("a"), ["a"], "b"), text("b"), ["b"], "a")
    near = (F.greatest(F.length("la"), F.length("lb")) >= LINKED) & may_be_within(F.col("la"), F.col("lb"), edits)
    near &= edit_distance_within(F.col("la"), F.col("lb"), edits) <= edits
    links = staged(full.where(near).select("a", "b"), "lines-links")
    discard(met, ends, texts)
    return links


def duplicate_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """For each document with a line to remove, or with links: doc, removed, n_links, kept_in.

    Lines that are not blank are in one class if they are equal or linked, over any number of links, by at most
    ``edits`` edits (see ``edit_links``). Of a class the first line by (doc_id, place) stays, all others are to be
    removed. removed holds their places in order, kept_in the doc_ids whose lines stay for them, n_links the links of
    the document's lines to other lines. Rows with the same doc_id and text are one document (null doc_ids come last);
    null and empty texts have no lines. Lines are equal if two 64-bit hashes of theirs are.
    """
    lines = lines_of(docs)
    repeated = lines.groupBy("node", "check").agg(F.count("*").alias("n")).where("n > 1")
    repeated = staged(repeated.groupBy("node").agg(F.sum("n").alias("n")), "lines-repeated")
    links = edit_links(lines.select("node", "line"), edits, repeated)
    roots = components(links, "lines-components")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    nodes = repeated.join(roots.join(ends, "node"), "node", "full")
    nodes = staged(nodes.select("node", "root", "links", F.coalesce("n", F.lit(1)).alias("n")), "lines-nodes")
    places = Bitmap(nodes.select("node"), "lines-nodes-bits").marked(lines.drop("line"), "node", "there").where("there")
    places = joined(places.drop("there"), nodes, ["node"], "doc")
    # Linked lines are known by their class, others by both hashes.
    places = places.select(
        "doc", "doc_id", "at",
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("check"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    places = staged(places, "lines-places")
    classes = places.groupBy("root", "check").agg(F.min(F.struct("doc_id", "at", "doc")).alias("first"), F.count("*").alias("n"))
    classes = staged(classes, "lines-classes")
    stays = F.expr("doc = first.doc AND at = first.at")
    found = joined(places, classes, ["root", "check"], "doc").select(
        "doc", F.struct("at", "links", F.col("first.doc_id").alias("kept_in"), stays.alias("stays")).alias("x")
    )
    # Repeated rows bring the same places again.
    found = found.groupBy("doc").agg(F.array_sort(F.collect_set("x")).alias("all"))
    gone = F.filter("all", lambda x: ~x["stays"])
    return found.select(
        "doc",
        F.transform(gone, lambda x: x["at"]).alias("removed"),
        F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["links"]).alias("n_links"),
        F.array_sort(F.array_distinct(F.transform(gone, lambda x: x["kept_in"]))).alias("kept_in"),
    )


def line_duplicates_of_documents(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, n_links, kept_in (the doc_ids that keep its lines)."""
    empty = F.array().cast("array<bigint>")
    own = docs.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("doc"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"),
    )
    return own.join(duplicate_lines(docs, edits), "doc", "left").select(
        "doc_id",
        F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("kept_in", empty).alias("kept_in"),
    )


def _without(lines: Column, removed: Column) -> Column:
    """The array without the places (0-based, in order): what stands between each two, put together."""
    ends = F.concat(removed, F.array(F.size(lines)))
    since = lambda i: F.when(i > 0, F.get(removed, F.greatest(i - 1, F.lit(0))) + 1).otherwise(0)
    return F.flatten(F.transform(ends, lambda end, i: F.slice(lines, since(i) + 1, end - since(i))))


def without_duplicate_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs without the lines to remove, and without rows of which only white space is left; docs' columns.

    Rows without a line to remove pass unchanged, null and empty texts too. Columns of any name stay. Only rows of
    documents that a bitmap lets through are shuffled.
    """
    found = duplicate_lines(docs, edits).where(F.size("removed") > 0).select("doc", "removed")
    found = staged(found, "lines-removed")
    own = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("doc"))
    own = Bitmap(found.select("doc"), "lines-removed-bits").marked(own, "doc", "there")
    cut = own.where("there").join(found, "doc", "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.transform(F.array(F.struct(lines.alias("lines"), "removed")), lambda x: F.array_join(_without(x["lines"], x["removed"]), "\n"))
    cut = cut.withColumn("kept", F.when(F.col("removed").isNotNull(), kept[0]))
    cut = cut.where(F.col("removed").isNull() | F.col("kept").rlike(r"\S"))
    row = F.when(F.col("removed").isNotNull(), F.col("row").withField("text", F.col("kept"))).otherwise(F.col("row"))
    return own.where("NOT there").select("row.*").union(cut.select(row.alias("row")).select("row.*"))
