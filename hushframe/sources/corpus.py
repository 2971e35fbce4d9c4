"""Synthetic pages with known personal data, from row numbers alone: the same at any parallelism."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.checksum import verhoeff_digit

#: Given and family names, streets and cities of made-up people.
GIVEN = ("Asha", "Ravi", "Meera", "Karan", "Divya", "Nikhil", "Priya", "Arjun")
FAMILY = ("Verma", "Sharma", "Nair", "Patel", "Reddy", "Iyer", "Gupta", "Singh")
STREETS = ("Lake Road", "Temple Street", "Station Road", "Garden Lane")
CITIES = ("Pune", "Nagpur", "Kochi", "Jaipur")
FIELDS = ("PERSON", "AADHAAR", "PAN", "ACCOUNT", "IFSC", "EMAIL", "PHONE", "DOB", "ADDRESS", "APPLICATION")
LABELS = {
    "PERSON": "Applicant Name", "AADHAAR": "Aadhaar Number", "PAN": "PAN", "ACCOUNT": "Account Number", "IFSC": "IFSC Code",
    "EMAIL": "Email", "PHONE": "Mobile Number", "DOB": "Date of Birth", "ADDRESS": "Address", "APPLICATION": "Application ID",
}


def number(key: Column, salt: int, below: int) -> Column:
    """A number under ``below`` from a key: one linear congruential step each for key and salt, within 63 bits."""
    mixed = ((key + F.lit(salt * 7919)) % 1_000_003 * 48_271 + F.lit(salt * 104_729 + 11)) % 2_147_483_647
    return F.floor((mixed * 16_807 % 2_147_483_647) / 7).cast("bigint") % below


def pick(key: Column, salt: int, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number(key, salt, len(words)) + 1).cast("int"))


def digits(key: Column, salt: int, n: int) -> Column:
    parts = [F.lpad(number(key, salt + i, 1000).cast("string"), 3, "0") for i in range(-(-n // 3))]
    return F.substring(F.concat(*parts), 1, n)


def letters(key: Column, salt: int, n: int) -> Column:
    return F.concat(*(F.chr(number(key, salt + i, 26) + 65) for i in range(n)))


def value(cls: str, key: Column) -> Column:
    """A made-up value of the class's shape."""
    if cls == "PERSON":
        return F.concat_ws(" ", pick(key, 1, GIVEN), pick(key, 2, FAMILY))
    if cls == "AADHAAR":
        eleven = F.concat((number(key, 3, 8) + 2).cast("string"), digits(key, 4, 10))
        whole = F.concat(eleven, verhoeff_digit(eleven).cast("string"))
        return F.concat_ws(" ", *(F.substring(whole, 1 + 4 * i, 4) for i in range(3)))
    if cls == "PAN":
        return F.concat(letters(key, 10, 5), digits(key, 15, 4), letters(key, 19, 1))
    if cls == "ACCOUNT":
        return F.concat(F.lit("30"), digits(key, 20, 12))
    if cls == "IFSC":
        return F.concat(letters(key, 30, 4), F.lit("0"), digits(key, 34, 6))
    if cls == "EMAIL":
        return F.concat(F.lower(pick(key, 1, GIVEN)), F.lit("."), digits(key, 40, 3), F.lit("@example.org"))
    if cls == "PHONE":
        return F.concat((number(key, 45, 4) + 6).cast("string"), digits(key, 46, 9))
    if cls == "DOB":
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return F.concat_ws("/", two(number(key, 50, 28) + 1), two(number(key, 51, 12) + 1), (number(key, 52, 40) + 1960).cast("string"))
    if cls == "ADDRESS":
        return F.concat((number(key, 55, 200) + 1).cast("string"), F.lit(", "), pick(key, 56, STREETS), F.lit(", "), pick(key, 57, CITIES), F.lit(" - "), digits(key, 58, 6))
    return F.concat(F.lit("APP"), digits(key, 60, 6))


def distractors(key: Column) -> Column:
    """Values that look personal but are not: a bad checksum, a phone-like and a PAN-like code, a transaction number."""
    eleven = F.concat((number(key, 70, 8) + 2).cast("string"), digits(key, 71, 10))
    bad = F.concat(eleven, ((verhoeff_digit(eleven) + 1) % 10).cast("string"))
    return F.array(bad, F.concat((number(key, 76, 4) + 2).cast("string"), digits(key, 77, 9)), F.concat(F.lit("FORM"), letters(key, 80, 1), digits(key, 81, 4), F.lit("X")), digits(key, 85, 13))


def text_pages(spark: SparkSession, n: int) -> DataFrame:
    """page_id, level, html and gold (array of struct<cls, text, start, end>): label and value rows, and notes.

    Thirds of the pages are of level 1 (all labelled), 2 (some labels generic) and 3 (some values only in notes, and
    distractors). A gold span is the first place of its value.
    """
    key = F.col("id")
    p = spark.range(n).withColumn("level", (F.floor(key * 3 / n) + 1).cast("int"))
    p = p.select("id", "level", *(value(cls, key).alias(cls) for cls in FIELDS), distractors(key).alias("others")).repartition("id")
    rows, notes, gold = [], [], []
    for i, cls in enumerate(FIELDS):
        v = F.col(cls)
        generic = (F.col("level") >= 2) & (number(key, 100 + i, 100) < 45)
        moved = (F.col("level") == 3) & (number(key, 120 + i, 2) == 0)
        label = F.when(generic, "Details").otherwise(LABELS[cls])
        row = F.concat(F.lit("<tr><td class='label'>"), label, F.lit("</td><td class='value'>"), v, F.lit("</td></tr>"))
        rows.append(F.when(~moved, row))
        notes.append(F.when(moved, F.concat(F.lit("Recorded as "), v, F.lit("."))))
        gold.append(F.struct(F.lit(cls).alias("cls"), v.alias("text")))
    more = F.when(F.col("level") == 3, F.array_join("others", "; "))
    html = F.concat(F.lit("<html><body><table>"), F.concat_ws("", *rows), F.lit("</table><input type='password'><p>"), F.concat_ws(" ", *notes, more), F.lit("</p></body></html>"))
    p = p.select(F.format_string("page_%08d", key).alias("page_id"), "level", html.alias("html"), F.array(*gold).alias("g")).repartition("page_id")
    placed = F.transform("g", lambda g: F.struct(g["cls"].alias("cls"), g["text"].alias("text"), (F.call_function("position", g["text"], F.col("html")) - 1).alias("start")))
    p = p.select(
        "page_id", "level", "html",
        F.transform(placed, lambda g: F.struct(g["cls"], g["text"], g["start"], (g["start"] + F.length(g["text"])).alias("end"))).alias("gold"),
    )
    # Readers use the page many times over: the exchange keeps its making from being repeated in each use.
    return p.repartition("page_id")


def visual_pages(spark: SparkSession, n: int) -> DataFrame:
    """Elements of made-up portals: page_id, ord, family, split, tag, role, box, text, label, input_type, and the gold
    columns cls and secret, which only scorers read. Two families are for development, four are held out."""
    families = ("scholarship", "hr", "health", "municipal", "banking", "transport")
    key = F.col("id")
    p = spark.range(n).withColumn("family", pick(key, 7, families))
    fields = F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(LABELS[c]).alias("label"), value(c, key).alias("text")) for c in FIELDS))
    controls = F.array(F.struct(F.lit("").alias("cls"), F.lit("Download Certificate").alias("label"), F.lit("").alias("text")))
    e = p.select("id", "family", F.posexplode(F.concat(fields, controls)).alias("ord", "f"))
    left, top = (number(key, 200, 60) + 40).cast("int"), (F.col("ord") * 52 + 90).cast("int")
    control = F.col("f.cls") == ""
    return e.select(
        F.format_string("%s_%08d", "family", key).alias("page_id"),
        "ord",
        "family",
        F.when(F.col("family").isin("scholarship", "hr"), "dev").otherwise("test").alias("split"),
        F.when(control, "button").otherwise("div").alias("tag"),
        F.when(control, "button").otherwise("text").alias("role"),
        F.struct(left.alias("x1"), top.alias("y1"), (left + 360).alias("x2"), (top + 40).alias("y2")).alias("box"),
        F.col("f.text").alias("text"),
        F.col("f.label").alias("label"),
        F.lit(None).cast("string").alias("input_type"),
        F.nullif(F.col("f.cls"), F.lit("")).alias("cls"),
        F.lit(None).cast("string").alias("secret"),
    )


def dom_blind(elements: DataFrame, percent: int = 34) -> DataFrame:
    """Elements without images and without about so many of a hundred text blocks, by the MD5 of page and place."""
    head = F.substring(F.md5(F.concat_ws("/", F.col("page_id").cast("string"), F.col("ord").cast("string"))), 1, 8)
    chance = F.conv(head, 16, 10).cast("bigint") % 100
    return elements.where((F.col("tag") != "img") & ~((F.col("role") == "text") & (chance < percent)))
