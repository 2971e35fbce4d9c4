"""The text profile's detector: labelled rows of HTML, shapes anywhere, and secret inputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rules, spans, text
from hushframe.functions.bind import let
from hushframe.functions.checksum import verhoeff_ok

# Labelled rows, and inputs that hold secrets.
ROW = r"<td class='label'>([^<]*)</td><td class='value'>([^<]*)</td>"
PASSWORD = r"<input[^>]*type=['\"]password['\"][^>]*>"
OTP = r"<input[^>]*name=['\"]otp['\"][^>]*>"


def trusted(cls: Column, value: Column) -> Column:
    """Whether a value looks like its label's class; classes without a rule take any value."""
    shapes = dict(rules.TEXT_FORMATS)
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(cls == "AADHAAR", verhoeff_ok(value))
        .when(cls == "PAN", whole(shapes["PAN"]))
        .when(cls == "IFSC", whole(shapes["IFSC"]))
        .when(cls == "EMAIL", F.contains(value, F.lit("@")))
        .when(cls == "ACCOUNT", whole("[0-9]{9,18}"))
        .when(cls == "APPLICATION", whole("[A-Z]{3}[0-9]{6}"))
        .otherwise(cls.isNotNull())
    )


def labelled_rows(html: Column) -> Column:
    """Spans of values whose label names a class that they look like."""
    rows = text.spans_of(html, ROW, "")

    def read(r: Column) -> Column:
        def span(value: Column) -> Column:
            end = r["end"] - F.length(F.lit("</td>"))
            cls = text.label_hint(F.regexp_extract(r["text"], ROW, 1), "text")
            return F.struct(cls.alias("cls"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("text"))

        return let(F.regexp_extract(r["text"], ROW, 2), span)

    return F.filter(F.transform(rows, read), lambda x: F.coalesce(trusted(x["cls"], x["text"]), F.lit(False)))


def detect_rows(pages: DataFrame) -> DataFrame:
    """Adds entities (labelled values first, then shapes that begin outside them) and secrets to page_id, html."""
    found = spans.with_matches(pages, "html", {"_passwords": ("PASSWORD", PASSWORD), "_otps": ("OTP", OTP)})
    found = found.withColumn("secrets", F.concat("_passwords", "_otps")).withColumn("_labelled", labelled_rows(F.col("html")))
    found = spans.with_spans(found, "html", "entities", "text", "_labelled")
    return found.select(*pages.columns, "entities", "secrets")


def redacted(pages: DataFrame) -> DataFrame:
    """Adds clean: entities as [CLASS_1], secret inputs as [CLASS_FIELD]."""
    tokens = F.concat(spans.tokens(F.col("entities")), spans.tokens(F.col("secrets"), "_FIELD]"))
    return spans.with_splice(pages, "html", tokens, "clean")
