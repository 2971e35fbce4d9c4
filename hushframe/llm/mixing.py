"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import WHITE, Bitmap, bounded, ranked, staged

#: Buckets at each of the two levels that narrow down where a source's sample ends.
BUCKETS = 1024
#: Logarithms of odds lie within so much of 0, with chances cut to LEAST and 1 - LEAST.
REACH, LEAST = 66.0, 1e-12
#: Equal rows that one task numbers.
RUN = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WHITE)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Words that each source gives: ``share`` of all words by ``weight``, none above ``cap`` times its size.

    A source above its cap gets the cap and the excess goes to the others by weight, again until none is above.
    Each round is one sum over the table of sources. Adds target.
    """
    limit = F.col("source_size") * F.lit(cap)
    level, capped = 0.0, -1
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"] * share
    while True:
        above = limit < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - row["fixed"]) / row["open"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)).cast("double"))


def numbered(docs: DataFrame, importance: Column | None) -> DataFrame:
    """doc_id, source, text (a hash of it), size, w and nth for each row of docs; nth counts rows that are equal in these.

    Equal rows collapse on the map side, and large groups of them are counted out again by many tasks.
    """
    weight = F.lit(1.0) if importance is None else F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("size"), weight.alias("w")
    )
    alike = staged(rows.groupBy("doc_id", "source", "hash", "size", "w").agg(F.count("*").alias("times")), "mix-alike")
    zero = F.lit(0).cast("bigint")
    few = alike.where(F.col("times") <= RUN).withColumn("nth", F.explode(F.sequence(zero, F.col("times") - 1)))
    runs = F.sequence(zero, F.floor((F.col("times") - 1) / RUN))
    many = alike.where(F.col("times") > RUN).withColumn("run", F.explode(runs)).repartition("doc_id", "hash", "run")
    last = F.least(F.col("times"), (F.col("run") + 1) * RUN) - 1
    many = many.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, last))).drop("run")
    return few.unionByName(many)


def scales(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (ix, rest) with scale, so that chances of min(1, scale times w) take ``rest`` words of each.

    Documents whose chance reaches 1 are certain; what they leave is shared among the others by w, again until no
    more become certain. Each round is one sum over the rows.
    """
    sources = sources.withColumn("scale", F.lit(None).cast("double"))
    before = -1
    while True:
        # Hot sources combine on the map side; the table of sources is small or joined by shuffle.
        sums = (
            sized.join(bounded(sources.select("ix", "scale"), sources.count()), "ix")
            .withColumn("sure", F.coalesce(F.col("scale") * F.col("w") >= 1, F.lit(False)))
            .groupBy("ix")
            .agg(
                F.sum(F.when(F.col("sure"), F.col("size")).otherwise(0)).alias("certain"),
                F.sum(F.when(~F.col("sure"), F.col("size") * F.col("w")).otherwise(0.0)).alias("open"),
                F.count_if("sure").alias("n_sure"),
            )
        )
        left = F.greatest(F.col("rest") - F.col("certain"), F.lit(0.0))
        again = sources.drop("scale").join(sums, "ix", "left")
        share = F.when(F.col("open") > 0, left / F.col("open")).otherwise(F.lit(0.0))
        # A document once certain stays so.
        scale = F.when(F.col("n_sure") > 0, F.greatest(share, F.col("old"))).otherwise(share)
        again = again.join(sources.select("ix", F.col("scale").alias("old")), "ix").withColumn("scale", scale)
        again = staged(again.drop("old", "certain", "open"), "mix-scales")
        sure = again.agg(F.coalesce(F.sum("n_sure"), F.lit(0))).first()[0]
        sources = again.drop("n_sure")
        if sure == before:
            return sources
        before = sure


def pareto_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    importance: Column | None = None,
    salt: int = 17,
) -> DataFrame:
    """Returns doc_id, source, hash (of text), times, size, source_size, target, chance, u, copies and taken (= copies
    x size) for each row of docs.

    Sources in code-point order (null last) take ``weights`` in turn. With rate = target / source_size every document
    gets floor(rate) whole copies for certain. The rest of the target is drawn by Pareto order sampling: a document's
    chance is ``importance`` (a column expression of docs; without it all are alike) times a scale for its source, 1
    at most, so that the expected words are the rest; its rank is the odds of a random number u over the odds of that
    chance. u is fixed by doc_id, text and, among rows equal in these, a running number: reruns agree. Documents are
    taken by rank as long as they fit the words that are left; the last place goes to the document whose size is
    nearest to what is then left, if that brings the source nearer to its target.

    The place where a source's sample ends is found by word sums over buckets of ranks, then over buckets of the
    bucket where it ends, so that no task sorts a whole source. Null or empty texts have size 0 and are never drawn
    beyond whole copies of nothing; rows that repeat a doc_id, or have none, are documents of their own; an empty table
    gives no rows; further columns are ignored. A null or negative importance counts as 0: never drawn.
    """
    sized = numbered(docs, importance)
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", "hash", "nth", F.lit(salt)), 11) + 0.5) / F.lit(float(2**53))
    sized = staged(sized.withColumn("u", unit), "mix-sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, F.col("source").asc_nulls_last(), "ix", "mix-sources")
    sources = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ix") % len(weights)).cast("int") + 1)
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = targets(sources, share, cap).withColumn("whole", F.floor(rate))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    sources = staged(sources.withColumn("rest", rest), "mix-targets")
    n = sources.count()
    small = lambda df: bounded(df, n)
    named = sources.select(F.col("source").alias("_source"), "ix")
    sized = sized.join(small(named), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    sources = scales(sized, sources.drop("source"))

    chance = F.greatest(F.least(F.col("scale") * F.col("w"), F.lit(1.0)), F.lit(0.0))
    cut = F.greatest(F.least(F.col("chance"), F.lit(1 - LEAST)), F.lit(LEAST))
    log_odds = lambda p: F.log(p / (1 - p))
    # Logarithms of ranks order like the ranks; they lie within REACH of 0.
    spot = F.least((log_odds(F.col("u")) - log_odds(cut) + REACH) / (2 * REACH) * BUCKETS * BUCKETS, F.lit(BUCKETS * BUCKETS - 1e-6))
    drawn = (
        sized.join(small(sources), "ix")
        .withColumn("chance", chance)
        .withColumn("spot", F.greatest(spot, F.lit(0.0)))
        .withColumn("b1", F.floor(F.col("spot") / BUCKETS))
        .withColumn("b2", F.floor("spot") % BUCKETS)
        .withColumn("at", F.struct("spot", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "hash", "nth", F.col("size").alias("n")))
    )
    pool = drawn.where("rest > 0 AND size > 0 AND w > 0")

    def end(sums: DataFrame, bucket: str, base: Column, name: str) -> DataFrame:
        """Where the words first pass the rest: the bucket, and the words before it."""
        run = Window.partitionBy("ix").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", base + F.coalesce(F.sum("n").over(run), F.lit(0)))
        return (
            before.where(F.col("before") + F.col("n") > F.col("rest"))
            .groupBy("ix")
            .agg(F.min(F.struct(bucket, "before")).alias("e"))
            .select("ix", F.col(f"e.{bucket}").alias(name), F.col("e.before").alias(f"{name}_before"))
        )

    first = end(pool.groupBy("ix", "b1", "rest").agg(F.sum("size").alias("n")), "b1", F.lit(0), "e1")
    inside = pool.join(small(first), "ix").where("b1 = e1")
    second = end(
        inside.groupBy("ix", "b2", "rest", "e1_before").agg(F.sum("size").alias("n")), "b2", F.col("e1_before"), "e2"
    )
    run = Window.partitionBy("ix").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        inside.join(small(second), "ix")
        .where("b2 = e2")
        .withColumn("upto", F.col("e2_before") + F.sum("size").over(run))
        .where("upto <= rest")
        .groupBy("ix")
        .agg(F.max(F.struct("at", "upto")).alias("l"))
    )
    cuts = staged(
        first.join(second, "ix")
        .join(last, "ix", "left")
        .select("ix", "e1", "e2", F.col("l.at").alias("cut"), F.coalesce("l.upto", "e2_before").alias("got")),
        "mix-cuts",
    )
    marked = drawn.join(small(cuts), "ix", "left").withColumn(
        "taken_once",
        F.expr("rest > 0 AND size > 0 AND w > 0")
        & (
            F.col("e1").isNull()
            | (F.col("b1") < F.col("e1"))
            | (F.expr("b1 = e1") & ((F.col("b2") < F.col("e2")) | (F.expr("b2 = e2") & F.coalesce(F.col("at") <= F.col("cut"), F.lit(False)))))
        ),
    )
    gap = F.abs(F.col("rest") - F.col("got") - F.col("size"))
    closing = (
        marked.where("NOT taken_once AND rest > 0 AND size > 0 AND w > 0 AND got IS NOT NULL")
        .where(gap < F.col("rest") - F.col("got"))
        .groupBy("ix")
        .agg(F.min(F.struct(gap.alias("gap"), "at")).alias("c"))
        .select("ix", F.col("c.at").alias("close"))
    )
    copies = F.col("whole") + (F.col("taken_once") | F.coalesce(F.col("at") == F.col("close"), F.lit(False))).cast("bigint")
    return marked.join(small(closing), "ix", "left").select(
        "doc_id", "source", "hash", "times", "size", "source_size", "target", "chance", "u", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def by_length() -> Column:
    """An importance that grows with the logarithm of a document's words: short texts are drawn less often."""
    return F.log1p(word_count(F.col("text")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, with copies and taken added (in place of columns of these names).

    Rows that agree in doc_id, source and text become one, whose copies and taken are the sums of theirs; of what
    else they hold one row's stays. Other columns of any name stay.
    """
    taken = pareto_mix(docs, **options).where("copies > 0")
    taken = taken.groupBy("doc_id", "source", "hash").agg(
        F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.max("times").alias("times")
    )
    key = lambda text: [F.xxhash64("doc_id", "source", text).alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id")]
    taken = staged(taken.select(*key("hash"), "copies", "taken", "times"), "mix-taken")
    row = F.struct(*(f"`{c}`" for c in docs.columns if c.lower() not in ("copies", "taken"))).alias("row")
    own = docs.select(row, "doc_id", "source", F.xxhash64("text").alias("hash")).select("row", *key("hash"))
    own = Bitmap(taken.where("times > 1").select("key"), "mix-repeated").marked(own, "key", "often")
    own = own.where("NOT often").unionByName(own.where("often").dropDuplicates(["id", "key"]))
    return own.join(taken, ["id", "key"]).select("row.*", "copies", "taken")
