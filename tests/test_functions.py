import pytest
from pyspark.sql import functions as F

from hushframe.functions import geometry as g
from hushframe.functions import text
from hushframe.functions.checksum import verhoeff_digit, verhoeff_ok


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_verhoeff_digit_makes_valid_numbers_and_any_change_breaks_them(spark):
    df = spark.range(300).select(F.lpad((F.col("id") * 987654321 + 20000000000).cast("string"), 11, "2").alias("e"))
    df = df.withColumn("n", F.concat("e", verhoeff_digit(F.col("e")).cast("string")))
    wrong = F.concat(F.substring("n", 1, 11), ((F.substring("n", 12, 1).cast("int") + 1) % 10).cast("string"))
    row = df.select(F.min(verhoeff_ok(F.col("n")).cast("int")), F.max(verhoeff_ok(wrong).cast("int"))).first()
    assert tuple(row) == (1, 0)
    assert one(spark, verhoeff_ok(F.lit("2345 6789 0123"))) is False
    assert one(spark, verhoeff_ok(F.lit("123"))) is False
    assert one(spark, verhoeff_ok(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(
    "value, label, profile, expected",
    [
        ("ABCDE1234F", "PAN", "browser", "PAN"),
        ("ravi@example.org", "Email", "browser", "EMAIL"),
        ("2345 6789 0123", "Aadhaar", "browser", "AADHAAR"),  # the label stands though the checksum fails
        ("2345 6789 0123", "Aadhaar", "runtime", "AADHAAR"),
        ("Ravi Verma", "Applicant Name", "runtime", "PERSON"),
        ("Ravi", "Applicant Name", "runtime", None),
        ("30123456789012", "Account", "runtime", "ACCOUNT"),
        ("30123456789012", "Employee ID", "runtime", None),
        ("EMP12345", "Employee ID", "runtime", "EMPLOYEE_ID"),
        ("Ravi Verma", "Patient", "browser", "PERSON"),
        ("Ravi Verma", "Patient", "runtime", None),
        ("1234567890123", "", "text", "ACCOUNT"),
        ("  ", "PAN", "runtime", None),
        (None, None, "runtime", None),
    ],
)
def test_classify(spark, value, label, profile, expected):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, text.classify(s(value), s(label), profile)) == expected


def test_hint_order_differs_by_profile(spark):
    label = F.lit("Student address")
    assert one(spark, text.label_hint(label, "text")) == "ADDRESS"
    assert one(spark, text.label_hint(label, "runtime")) == "PERSON"
    assert one(spark, text.label_hint(label, "browser")) == "ADDRESS"


def test_spans_keep_positions_beside_accents(spark):
    t = F.lit("né a.b@example.org 30123456789012 été")
    spans = one(spark, text.detect_spans(t, "text"))
    assert [(x.cls, x.start, x.end, x.text) for x in spans] == [
        ("EMAIL", 3, 18, "a.b@example.org"),
        ("ACCOUNT", 19, 33, "30123456789012"),
    ]
    assert one(spark, text.redact(t, text.detect_spans(t, "text"))) == "né [EMAIL_1] [ACCOUNT_1] été"


def test_phone_suffix_only_in_text_profile(spark):
    t = F.lit("no 129876543210 here")
    assert "PHONE" in {x.cls for x in one(spark, text.detect_spans(t, "text"))}
    assert "PHONE" not in {x.cls for x in one(spark, text.detect_spans(t, "runtime"))}


def test_tokenise_counts_by_class(spark):
    goals = spark.createDataFrame([("Send ABCDE1234F and FGHIJ5678K to a@b.org, not 2345 6789 0123",), ("",), (None,)], "goal string")
    got = [r.goal for r in text.tokenised(goals, "goal").collect()]
    assert got == ["Send [PAN_1] and [PAN_2] to [EMAIL_1], not 2345 6789 0123", "", None]


def test_names_only_without_addresses(spark):
    find = lambda t: [(x.cls, x.text) for x in one(spark, text.contextual_spans(F.lit(t)))]
    assert find("Visit Ravi Verma at 12, Lake Road, Pune - 411001 today") == [("ADDRESS", "12, Lake Road, Pune - 411001")]
    assert find("Issued to Ravi Verma by Cooperative Bank") == [("PERSON", "Ravi Verma")]
    assert find("Ravi Verma") == []


def test_terms_and_scores(spark):
    assert one(spark, text.terms(F.lit("Please download MY income-certificate of 2024"))) == ["download", "income", "certificate", "2024"]
    goal, label = text.terms(F.lit("download certificate")), text.terms(F.lit("Certificates list"))
    assert one(spark, text.goal_score(goal, label)) == 0.5
    assert one(spark, text.goal_score(text.terms(F.lit("to the")), label)) == 0.0


def test_geometry(spark):
    b = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))))
    assert one(spark, g.iou(b(0, 0, 10, 10), b(5, 0, 15, 10))) == 50 / 150
    assert one(spark, g.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert one(spark, g.coverage(b(0, 0, 0, 0), b(0, 0, 5, 5))) == 0.0
    assert one(spark, g.inside(b(0, 0, 12, 10), b(2, 2, 10, 8))) is True
    assert one(spark, g.near(b(0, 0, 10, 10), b(5, 130, 15, 140))) is True
    assert one(spark, g.near(b(0, 0, 10, 10), b(5, 131, 15, 140))) is False
    s = one(spark, g.scaled(b(10, -1, 21, 3), F.lit(2.0), F.lit(1.5)))
    assert tuple(s) == (20, -1, 42, 5)
    assert one(spark, g.union_area(F.array(b(0, 0, 10, 10), b(5, 5, 15, 15), b(0, 0, 10, 10)))) == 175
    assert one(spark, g.union_area(F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))) == 0
