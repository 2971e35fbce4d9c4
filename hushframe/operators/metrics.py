"""Scores of predictions against ground truth, and of latencies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.geometry import union_area
from hushframe.functions.pixels import union_pixels
from hushframe.sources.staging import staged


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def per_class_and_micro(outcomes: DataFrame, cls: str = "cls") -> DataFrame:
    """Of rows (cls, tp, fp, fn) the sums by class and in all (cls null) in one pass, with precision, recall and f1."""
    sums = outcomes.rollup(cls).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return prf(sums)


def leakage(spans: DataFrame, *by: str) -> DataFrame:
    """Characters of gold spans that no prediction matched, of all: spans carry chars and matched."""
    out = spans.groupBy(*by).agg(F.sum(F.when(~F.col("matched"), F.col("chars")).otherwise(0)).alias("leaked"), F.sum("chars").alias("chars"))
    return out.withColumn("rate", ratio(F.col("leaked"), F.col("chars")))


def exposure(pages: DataFrame, raw: str, clean: str, *by: str) -> DataFrame:
    out = pages.groupBy(*by).agg(F.sum(F.octet_length(clean)).alias("clean_bytes"), F.sum(F.octet_length(raw)).alias("raw_bytes"))
    return out.withColumn("ratio", ratio(F.col("clean_bytes"), F.col("raw_bytes")))


#: Buckets that a range of values is cut into on the way to a rank, and groups whose ranges are broadcast.
RANK_BUCKETS, BROADCAST_GROUPS = 4096, 10_000


def at_ranks(values: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n and, under each name, the value of that rank (from 1) among a group's values; ranks are expressions of n.

    Values are doubles or anything that casts to them without loss; nulls don't count, NaN is the greatest. Each round
    counts a group's values by buckets of the range that the rank is known to lie in, and goes on with the one bucket
    that holds it, until that has one value: two rounds for some ten million even values, one more for each factor of
    RANK_BUCKETS. Counts combine on the map side, and a group's buckets are few, so that no task holds a group. The
    infinite have buckets of their own. values are read once a round: they are stored first.
    """
    v = values.select(F.col(by), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    v = staged(v, "ranks")
    kinds = F.array(*(F.struct(F.lit(k).alias("_kind"), r.cast("bigint").alias("_rank")) for k, r in ranks.items()))
    sums = v.groupBy(by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = sums.withColumn("_k", F.explode(kinds)).select(by, "n", "_lo", "_hi", "_k.*", F.lit(0).cast("bigint").alias("_before"))
    wanted = staged(wanted, "ranks-wanted")
    found = []
    while True:
        # NaN equals NaN here, so that a group of nothing else is found at once.
        found.append(wanted.where("_lo = _hi").select(by, "n", "_kind", F.col("_lo").alias("_at")))
        wanted = wanted.where("_lo != _hi")
        left = wanted.count()
        if not left:
            break
        end = lambda x, cap: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(cap)).otherwise(x)
        lo, hi, x = end(F.col("_lo"), -1.7976931348623157e308), end(F.col("_hi"), 1.7976931348623157e308), F.col("_v")
        # Halves keep the range of the greatest doubles finite; one too small for a double has its greatest value apart.
        part = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)
        bucket = (
            F.when(F.isnan(x), RANK_BUCKETS + 1).when(x == float("inf"), RANK_BUCKETS).when(x == float("-inf"), -1)
            .when(x >= hi, RANK_BUCKETS - 1).otherwise(F.coalesce(F.least(F.floor(part * (RANK_BUCKETS - 1)), F.lit(RANK_BUCKETS - 2)), F.lit(0)))
        )
        ranges = wanted.select(by, "_kind", "_lo", "_hi")
        near = v.join(F.broadcast(ranges) if left <= BROADCAST_GROUPS else ranges, by).where("_v >= _lo AND _v <= _hi")
        counts = near.groupBy(by, "_kind", bucket.cast("int").alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(by, "_kind").orderBy("_b"))
        placed = counts.join(wanted.drop("_lo", "_hi"), [by, "_kind"]).withColumn("_upto", upto + F.col("_before")).where("_upto >= _rank")
        first = placed.groupBy(by, "n", "_kind", "_rank").agg(F.min(F.struct("_b", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_before"))).alias("_f"))
        wanted = staged(first.select(by, "n", "_f._lo", "_f._hi", "_kind", "_rank", "_f._before"), "ranks-wanted")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(by, "n").agg(*(F.max(F.when(F.col("_kind") == k, F.col("_at"))).alias(k) for k in ranks))


def latency(samples: DataFrame, by: str, page: str, order: list[str], value: str, warm: int = 0) -> DataFrame:
    """n, median and p95 by group, without the first ``warm`` samples of each page.

    The p95 is the sample of rank max(1, floor(0.95 n)), the median the mean of the two in the middle.
    """
    warmed = samples
    if warm:
        warmed = samples.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(*order))).where(F.col("_n") > warm)
    n = F.col("n")
    ranks = {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1, "p95": F.greatest(F.lit(1).cast("bigint"), F.floor(n * 95 / 100))}
    placed = at_ranks(warmed, by, value, ranks)
    return placed.select(by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95")


def masked_pixels(pages: DataFrame, width: int, height: int) -> DataFrame:
    """By page (masks, sensitive: arrays of boxes) the pixels of each union, of both together, and of their overlap.

    Counted for a batch of pages at once; the function counts as not deterministic so that no filter runs it again.
    """
    p = pages.withColumn("_px", union_pixels(F.col("masks"), F.col("sensitive"), width, height))
    p = p.select(*(F.col(f"`{c}`") for c in pages.columns if c not in ("masks", "sensitive")), "_px.*")
    return p.withColumn("both_px", F.col("mask_px") + F.col("sensitive_px") - F.col("either_px"))


def target_visible(target: Column, masks: Column, most: float = 0.5) -> Column:
    """Whether masks leave at least half of a target to be seen."""
    inner = F.filter(
        F.transform(
            masks,
            lambda m: F.struct(
                F.greatest(m["x1"], target["x1"]).alias("x1"), F.greatest(m["y1"], target["y1"]).alias("y1"),
                F.least(m["x2"], target["x2"]).alias("x2"), F.least(m["y2"], target["y2"]).alias("y2"),
            ),
        ),
        lambda b: (b["x1"] < b["x2"]) & (b["y1"] < b["y2"]),
    )
    size = (target["x2"] - target["x1"]) * (target["y2"] - target["y1"])
    return union_area(inner) <= size * most


def weakest(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.orderBy("recall", "cls").limit(n)


def summary(samples: DataFrame) -> DataFrame:
    """Of rows (rss_mb, cpu_ms, ocr_calls) the peak and the means."""
    return samples.agg(F.max("rss_mb").alias("peak_mb"), F.avg("cpu_ms").alias("cpu_ms"), F.avg("ocr_calls").alias("ocr_per_page"))
