"""Sharding along a Hilbert curve: quantise several dimensions of metadata, order by curve index, cut into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import bounded, joined, staged

#: Each dimension is quantised to 2**BITS cells that hold about equally many documents.
BITS = 8
#: A group of equal texts up to this share of a shard is never parted; a larger one may be, so that sizes stay near equal.
WHOLE = 0.05


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """The curve as an automaton, by state * 2**dims + corner: the place of that corner on the curve, and the next state.

    A state is an entry corner and a direction: entry * dims + direction. At the top it is 0.
    """
    side, full = 1 << dims, (1 << dims) - 1
    gray = [k ^ (k >> 1) for k in range(side)]
    place = {g: k for k, g in enumerate(gray)}

    def ones(k: int) -> int:
        n = 0
        while k >> n & 1:
            n += 1
        return n

    def left(k: int, by: int) -> int:
        by %= dims
        return (k << by | k >> (dims - by)) & full

    first, state = [], []
    for entry in range(side):
        for direction in range(dims):
            for corner in range(side):
                w = place[left(corner ^ entry, -(direction + 1))]
                into = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
                turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
                first.append(w)
                state.append((entry ^ left(into, direction + 1)) * dims + (direction + turn + 1) % dims)
    return first, state


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a cell (an integer below 2**bits for each dimension) on the Hilbert curve through all cells."""
    dims = len(cells)
    first, state = (F.array(*map(F.lit, t)) for t in curve_tables(dims))

    def down(at: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", c.cast("int"), bit).bitwiseAND(1) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
        spot = (at["state"] * (1 << dims) + corner).cast("int")
        return F.struct(F.get(state, spot).alias("state"), (at["index"] * (1 << dims) + F.get(first, spot)).alias("index"))

    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), begin, down)["index"]


def running(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """Adds, under each name in ``sums``, the sum of a column over all rows before this one in ``order`` (of no ties).

    Rows are dealt out by ranges of the order; the driver sees one row of totals for each range.
    """
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    zero = F.lit(0).cast("bigint")
    spread = staged(
        spread.withColumns({name: F.coalesce(F.sum(c).over(before), zero).cast("bigint") for name, c in sums.items()}), label
    )
    totals = spread.groupBy("_part").agg(*(F.sum(c).cast("bigint").alias(name) for name, c in sums.items())).collect()
    rows, upto = [], dict.fromkeys(sums, 0)
    for t in sorted(totals, key=lambda t: t["_part"]):
        rows.append((t["_part"], *upto.values()))
        upto = {name: n + t[name] for name, n in upto.items()}
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["_part int", *(f"_{name} bigint" for name in sums)]))
    out = spread.join(F.broadcast(offsets), "_part")
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", *(f"_{name}" for name in sums))


def with_cell(groups: DataFrame, dim: str, total: int, bits: int, label: str) -> DataFrame:
    """groups (n: documents of each) with dim's value replaced by its cell: cells hold about equally many documents.

    Equal values share a cell; values order as they do in Spark, null last.
    """
    values = groups.groupBy(dim).agg(F.sum("n").alias("n"))
    placed = running(values, [F.col(dim).asc_nulls_last()], {"before": "n"}, f"{label}-{dim}")
    cell = F.expr(f"least({(1 << bits) - 1}, ((2 * before + n) * {1 << bits}) div {2 * max(total, 1)})").cast("int")
    placed = staged(placed.select(dim, "n", cell.alias("_cell")), f"{label}-{dim}-cells")
    absent, value = F.col(dim).isNull(), F.col(dim)
    key = lambda df: df.withColumn("_null", absent).withColumn("_value", F.coalesce(value.cast("string"), F.lit(""))).drop(dim)
    n = placed.count()
    if n <= 200_000:
        out = key(groups).join(bounded(key(placed).drop("n"), n), ["_null", "_value"])
    else:
        out = joined(key(groups), key(placed), ["_null", "_value"], "g")
    return out.drop("_null", "_value").withColumnRenamed("_cell", dim)


def hilbert_places(
    docs: DataFrame,
    dims: tuple[str, ...] = ("lang", "source"),
    shards: int = 8,
    law: str = "bytes",
    whole: float = WHOLE,
    bits: int = BITS,
) -> DataFrame:
    """Returns row, doc_id, size, text_crc32, curve, shard and slot for each row of docs (doc_id, text, dims, and row: a
    unique long, added if it is not there).

    Rows are ordered by the Hilbert index of ``dims`` and their size in bytes, quantised to cells of about equally many
    documents, then by a digest of the text, doc_id (null first) and row. The order is cut into runs. Law ``bytes``:
    a document lies in the shard in which the middle of its bytes falls, and a group of equal texts of at most ``whole``
    of a shard in that of the group's middle: shards' bytes differ by about that share at most, but for single documents
    that are larger. Law ``rows``: numbers of documents differ by one at most, whatever their texts. slot counts the
    rows of a shard from 0 in order.

    All copies of a text take the least dims of any of them, so that they stand together. A null text has no bytes
    (size 1) and crc 0; null dims are a value of their own; rows that repeat are placed one by one; an empty table gives
    no rows, shards with nothing have no rows; dims may have any type that orders; other columns are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law: bytes or rows, not {law}")
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        row.alias("row"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("g"), *(F.col(c).alias(f"_d{k}") for k, c in enumerate(dims)),
    )
    names = [f"_d{k}" for k in range(len(dims))]
    rows = staged(rows, "shard-rows")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("size").alias("size"), *(F.min(c).alias(c) for c in names))
    groups = staged(groups.withColumn("_size", F.col("size")), "shard-groups")
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("b")).first()
    for c in [*names, "_size"]:
        groups = with_cell(groups, c, sums["n"], bits, "shard")
    groups = groups.withColumn("curve", hilbert_index([F.col(c) for c in [*names, "_size"]], bits)).drop(*names, "_size")
    many = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    groups = groups.withColumns({"bytes": F.col("n") * F.col("size"), "many": many})
    starts = {"row0": "n", "byte0": "bytes", "many0": "many"}
    groups = staged(running(groups, [F.col("curve"), F.col("g")], starts, "shard-order").drop("many", "bytes", "size"), "shard-starts")

    placed = staged(joined(rows.drop(*names), groups.withColumn("copies", F.col("n")), ["g"], "row"), "shard-placed")
    single = placed.where("copies = 1").withColumn("nth", F.lit(0).cast("bigint"))
    copies = placed.where("copies > 1").withColumn("_one", F.lit(1).cast("bigint"))
    order = [F.col("curve"), F.col("g"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    copies = running(copies, order, {"_at": "_one"}, "shard-copies").withColumn("nth", F.col("_at") - F.col("many0"))
    placed = single.unionByName(copies.drop("_one", "_at")).withColumn("position", F.col("row0") + F.col("nth"))
    if law == "rows":
        shard = F.expr(f"(position * {shards}) div {max(sums['n'], 1)}")
    else:
        together = F.col("copies") * F.col("size") <= F.lit(int(whole * sums["b"] / shards))
        twice = F.when(together, 2 * F.col("byte0") + F.col("copies") * F.col("size")).otherwise(2 * (F.col("byte0") + F.col("nth") * F.col("size")) + F.col("size"))
        placed = placed.withColumn("_twice", twice)
        shard = F.expr(f"least({shards - 1}, (_twice * {shards}) div {2 * max(sums['b'], 1)})")
    placed = staged(
        placed.withColumn("shard", shard.cast("int")).select("row", "doc_id", "size", "text_crc32", "curve", "position", "shard"),
        "shard-shards",
    )
    # At most one row for each shard.
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("position") - F.col("_first")).drop("_first", "position")


def shards_of_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: shards are cut anew when their number grows), curve."""
    law = options.get("law", "bytes")
    placed = hilbert_places(docs, **options)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, file_rows: int = 100_000, **options) -> DataFrame:
    """Writes docs to path as Parquet, in a folder for each shard and in files that are runs of the curve, and reads it.

    Every column of docs is kept; shard and slot are added in place of columns of these names. Files hold about
    ``file_rows`` rows in slot order, so that the least and greatest values in their footers rule most of them out for a
    filter on any of the dimensions.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    kept = staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(f"`{c}`" for c in own)).alias("_doc")), "shard-docs")
    flat = kept.select("_doc.*", F.col("_row").alias("row")) if "row" not in own else kept.select(*(f"_doc.`{c}`" for c in own if c != "row"), F.col("_row").alias("row"))
    places = hilbert_places(flat, **options).select(F.col("row").alias("_row"), "shard", "slot")
    files = max(1, -(-kept.count() // file_rows))
    out = kept.join(places, "_row").select("_doc.*", "shard", "slot")
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _sql() -> str:
    """The same rows in DuckDB: digests, cells, curve and runs as above; CRC-32 by its table."""
    first, state = curve_tables(3)
    crc = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        crc.append(k)
    total, most = "(SELECT sum(n) FROM g)", (1 << BITS) - 1
    cells = ", ".join(
        f"""c{k} AS (SELECT v, CAST(least({most}, ((2 * coalesce(sum(n) OVER (ORDER BY v NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n) * {1 << BITS})
             // (2 * {total})) AS BIGINT) c FROM (SELECT {v} v, sum(n) n FROM g GROUP BY 1))"""
        for k, v in enumerate(("lang", "source", "size"))
    )
    corner = " + ".join(f"((c{k}.c >> b) & 1) * {1 << k}" for k in range(3))
    corners = f"list_transform({list(range(BITS - 1, -1, -1))}, lambda b: {corner})"
    step = f"{{'s': ({state})[a.s * 8 + x.i + 1], 'i': a.i * 8 + ({first})[a.s * 8 + x.i + 1]}}"
    return f"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) size, coalesce(md5(text), '') k,
               CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
                    lambda a, x: xor(a >> 8, ({crc})[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) text_crc32 FROM documents),
    g AS (SELECT k, count(*) n, min(size) size, min(lang) lang, min(source) source FROM d GROUP BY k), {cells},
    h AS (SELECT k, n, size, list_reduce(list_transform({corners}, lambda x: {{'s': CAST(0 AS BIGINT), 'i': CAST(x AS BIGINT)}}), lambda a, x: {step}, {{'s': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT)}}).i curve
          FROM g JOIN c0 ON c0.v IS NOT DISTINCT FROM lang JOIN c1 ON c1.v IS NOT DISTINCT FROM source JOIN c2 ON c2.v = size),
    o AS (SELECT *, coalesce(sum(n) OVER w, 0) row0, coalesce(sum(n * size) OVER w, 0) byte0 FROM h
          WINDOW w AS (ORDER BY curve, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT sum(size) b FROM d),
    p AS (SELECT doc_id, d.size, text_crc32, curve, n, row0, byte0, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, rid) - 1 nth FROM d JOIN o USING (k)),
    s AS (SELECT *, CAST(least(7, (CASE WHEN n * size <= floor({WHOLE} * b / 8) THEN 2 * byte0 + n * size ELSE 2 * (byte0 + nth * size) + size END) * 8 // (2 * b)) AS INT) shard FROM p, t)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row0 + nth) - 1 AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM s"""


SQL = _sql()
