"""Pages, elements and requests derived from the driver's tables with arithmetic that every SQL engine agrees on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.times import millis

#: Boxes on pages: one page for each order. The same text runs on Spark and DuckDB; {lineitem} is the table.
BOXES = """
SELECT l_orderkey AS page_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS ord,
       CAST((l_partkey * 7) % 900 AS INT) AS x1, CAST((l_suppkey * 13) % 560 AS INT) AS y1,
       CAST((l_partkey * 7) % 900 + 120 + l_quantity * 4 AS INT) AS x2,
       CAST((l_suppkey * 13) % 560 + 60 + l_linenumber * 10 AS INT) AS y2,
       floor(l_discount * 100 + 0.5) / 100 AS score,
       CASE l_returnflag WHEN 'A' THEN 'AADHAAR' WHEN 'N' THEN 'ADDRESS' ELSE 'PERSON' END AS cls,
       l_linestatus AS side,
       CASE l_partkey % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'textbox' WHEN 3 THEN 'combobox' ELSE 'text' END AS role,
       CASE l_suppkey % 5 WHEN 0 THEN 'Download income certificate' WHEN 1 THEN 'Print receipt' WHEN 2 THEN 'Help'
            WHEN 3 THEN 'Certificate number' ELSE 'Upload my documents' END AS label,
       l_partkey % 7 <> 0 AS enabled, l_suppkey % 3 <> 0 AS same_origin
FROM {lineitem}
"""
BOXES_SQL = BOXES.format(lineitem="lineitem")
#: IoU and its parts for aliases a and b.
INTER = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
AREA = "(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def inter(a: str, b: str) -> str:
    return f"({INTER.format(a=a, b=b)})"


def union(a: str, b: str) -> str:
    return f"({AREA.format(a=a)} + {AREA.format(a=b)} - {inter(a, b)})"


def iou(a: str, b: str) -> str:
    return f"(CAST({inter(a, b)} AS DOUBLE) / {union(a, b)})"


def cover(a: str, b: str) -> str:
    return f"(CAST({inter(a, b)} AS DOUBLE) / {AREA.format(a=a)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that sorts a table by page: as many as need no spill.
TASK_ROWS = 200_000


def boxes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """page_id, ord, box and what else BOXES derives.

    dealt: for plans that read the boxes several times, by page only. The lines as they are, and not what is derived from
    them, are dealt out by page, into as many parts as keep a sort in memory; reads that need the same columns of lines
    share that one shuffle.
    """
    lines = table(spark, sf_dir, "lineitem")
    if dealt:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))
        lines = lines.repartition(parts, "l_orderkey")
    rows = spark.sql(BOXES, lineitem=lines)
    return rows.withColumn("box", F.struct("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ms, milliseconds since 1970, rounded."""
    return table(spark, sf_dir, "events").withColumn("ms", millis(F.col("ts").cast("timestamp")))
