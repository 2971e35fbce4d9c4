"""Page snapshots and their files: readers, elements of stored HTML, result sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.sources.versions import KeyedTable

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
ELEMENT = "tag string, role string, rect array<int>, text string, label string, input_type string, autocomplete string"
SNAPSHOT = f"width int, height int, family string, split string, dom_blind boolean, elements array<struct<{ELEMENT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
TRUTH = "family string, split string, elements array<struct<cls:string,box:array<int>,pii:string,secret:string,text:string>>"


def _stem(suffix: str):
    return F.regexp_extract(F.input_file_name(), rf"([^/]+?){suffix}$", 1)


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """page_id (the file's stem) and html of each .html file."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(folder)
    return whole.select(_stem(r"\.html").alias("page_id"), F.col("value").alias("html"))


def screenshots(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)\.[^.]+$", 1).alias("page_id"), "content", "length")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Stored page snapshots (*.dom.json), a row for each."""
    files = spark.read.schema(SNAPSHOT).option("multiLine", True).option("pathGlobFilter", "*.dom.json").json(folder)
    return files.withColumn("page_id", _stem(r"\.dom\.json"))


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth (*.gt.json). Only scorers read it."""
    files = spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "*.gt.json").json(folder)
    return files.withColumn("page_id", _stem(r"\.gt\.json"))


def with_truths(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with the ground truth of the file that shares their stem (truth; null without one), for scorers."""
    gold = truths(spark, folder)
    return snapshots(spark, folder).join(gold.select("page_id", F.struct("family", "split", "elements").alias("truth")), "page_id", "left")


def elements(pages: DataFrame) -> DataFrame:
    """One row for each element of snapshots: page_id, ord, box and the element's fields."""
    e = pages.select("page_id", F.posexplode("elements").alias("ord", "e")).select("page_id", "ord", "e.*")
    side = lambda i, n: F.get("rect", i).cast("int").alias(n)
    return e.withColumn("box", F.struct(side(0, "x1"), side(1, "y1"), side(2, "x2"), side(3, "y2"))).drop("rect")


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, ord, href and text of each link in stored HTML (page_id, url, html)."""
    pattern = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("text")
    )
    return pages.select("page_id", "url", F.posexplode(found).alias("ord", "l")).select("page_id", "url", "ord", "l.href", "l.text")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_results(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The results at path with those of the same keys replaced by df's; readers see all of the change or none of it."""
    table = KeyedTable(df.sparkSession, path, df.schema, keys)
    table.upsert(df)
    return table.read()
