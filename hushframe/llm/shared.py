"""What several corpus operators share: staged tables, folds, ordering and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.sources.staging import staged

#: A table is broadcast by hint only up to this many rows, counted beforehand.
BROADCAST_ROWS = 200_000

WHITE = r"[^\x20\x09-\x0D]+"


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``staged`` that nothing reads any more: only once what was made of them is staged itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; otherwise Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: Column, name: str, label: str) -> DataFrame:
    """Adds the 0-based place of each row under ``order``, without bringing the rows together in one task."""
    from pyspark.sql import Window

    spread = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    spread = staged(
        spread.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1), label
    )
    # One row for each partition, however many rows there are.
    counts = sorted((r["_part"], r["count"]) for r in spread.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    return (
        spread.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_place") + F.col("_before"))
        .drop("_part", "_place", "_before")
    )


#: Keys that may be split as hot: the most frequent of a table, so that all others hold under 1/HOT of its rows each.
HOT = 1_000
#: Rows of a hot key that meet in one task, about, and the most parts of a key.
PART, MOST_PARTS = 1_000, 10_000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows joined with facts by keys, where facts have one row for each key and in ``n`` about the number of its rows.

    The rows of the HOT most frequent keys are dealt out by a hash of ``spread``, and the facts of such a key are
    repeated for each of its parts, so that no task gets all rows of one. facts are read twice: give a staged table.
    """
    parts = F.least(F.ceil(F.col("n") / PART), F.lit(MOST_PARTS)).cast("int")
    hot = F.broadcast(facts.orderBy(F.desc("n")).limit(HOT).where(F.col("n") > PART).select(*keys, parts.alias("_parts")))
    many = F.coalesce("_parts", F.lit(1))
    rows = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.hash(spread), many)).drop("_parts")
    facts = facts.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts", "n")
    return rows.join(facts, [*keys, "_part"]).drop("_part")


#: A bitmap's bits for each of its members, about, and the most bits that a bitmap is given: 32 MiB.
BITS_EACH, MOST_BITS = 16, 1 << 28
_SLICE = 1 << 15  # bits of a row of a bitmap, as bitmap_construct_agg makes it


class Bitmap:
    """A set of hashes (long) as a bitmap of bounded size in a broadcast, for a superset of the rows that are in it."""

    def __init__(self, hashes: DataFrame, label: str):
        """hashes: one column. At first no more than their number is looked at."""
        name, n = hashes.columns[0], hashes.count()
        self.slices = min(MOST_BITS, max(_SLICE, n * BITS_EACH)) // _SLICE
        cut, bit = self._place(F.col(name))
        self.rows = staged(hashes.groupBy(cut.alias("_cut")).agg(F.bitmap_construct_agg(bit).alias("_bits")), label)

    def _place(self, value: Column) -> tuple[Column, Column]:
        spot = F.pmod(value, F.lit(self.slices * _SLICE))
        return F.floor(spot / _SLICE).cast("int"), spot % _SLICE

    def marked(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with a boolean: false only where the column's value is not in the set."""
        cut, bit = self._place(F.col(column))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = df.withColumn("_cut", cut).join(F.broadcast(self.rows), "_cut", "left")
        return out.withColumn(name, F.coalesce(there, F.lit(False))).drop("_cut", "_bits")


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of links (a, b: long): every linked node with the least node that it reaches.

    Each round passes the least known label over the links, hooks the former label's own node to it and then
    jumps two labels at once, so that rounds grow with the logarithm of a component's diameter. Rounds use joins
    and minima that combine on the map side; each is staged, and the one before it deleted. What the HOT nodes of most
    links and the HOT labels of most nodes are joined with is broadcast, so that neither a hub nor a huge component
    lands in one task; up to BROADCAST_ROWS links, all of which one task can hold, are joined plainly. Self-links are
    allowed; no links give no rows.
    """
    both = staged(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label
    )
    few = both.count() <= BROADCAST_ROWS
    hubs = None if few else staged(both.groupBy("b").count().orderBy(F.desc("count")).limit(HOT).select("b"), label)
    known = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), label)

    def looked_up(df: DataFrame, key: str, hot: DataFrame | None, table: DataFrame, name: str) -> DataFrame:
        """df with, under ``name``, what the table (key, value) has for df's key; hot keys by a broadcast of theirs."""
        if hot is None:
            return df.join(table, key)
        near = table.join(F.broadcast(hot), key).withColumnRenamed(name, "_hot")
        out = df.join(F.broadcast(near), key, "left")
        # A row of a hot key looks up its own node instead: any key will do that spreads.
        far = table.select(F.col(key).alias("_key"), name)
        out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.col("a"))).join(far, "_key")
        return out.withColumn(name, F.coalesce("_hot", name)).drop("_key", "_hot")

    while True:
        state = known.select("a", "root")
        seen = looked_up(both, "b", hubs, state.select(F.col("a").alias("b"), F.col("root").alias("r")), "r")
        seen = seen.groupBy("a").agg(F.min("r").alias("m"))
        offer = state.join(seen, "a").select("a", "root", F.least("m", "root").alias("m"))
        hooked = staged(
            offer.select("a", "m").union(offer.select(F.col("root").alias("a"), "m")).groupBy("a").agg(F.min("m").alias("m")),
            label,
        )
        large = None if few else hooked.groupBy("m").count().orderBy(F.desc("count")).limit(HOT).select("m")
        jump = looked_up(hooked, "m", large, hooked.select(F.col("a").alias("m"), F.col("m").alias("mm")), "mm")
        jump = jump.select("a", F.least("m", "mm").alias("root"))
        new = staged(jump.join(state.withColumnRenamed("root", "old"), "a"), label)
        moved = new.where("root != old").limit(1).count()
        discard(known, hooked)
        known = new
        if not moved:
            discard(both, *([] if few else [hubs]))
            return new.select(F.col("a").alias("node"), "root")
