"""Elements of page snapshots: what is kept, and what their attributes mean."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(value: Column, most: int = 160) -> Column:
    """White space runs become one space; trimmed; cut."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), 1, most)


def visible(box: Column, width: Column, height: Column, visibility: Column, display: Column, opacity: Column) -> Column:
    """At least 6 pixels each way, touching the viewport, and not hidden by style."""
    return (
        (box["x2"] - box["x1"] >= 6) & (box["y2"] - box["y1"] >= 6)
        & (box["y2"] >= 0) & (box["y1"] <= height) & (box["x2"] >= 0) & (box["x1"] <= width)
        & (F.coalesce(visibility, F.lit("")) != "hidden") & (F.coalesce(display, F.lit("")) != "none") & (F.coalesce(opacity, F.lit("1")) != "0")
    )


def role_of(explicit: Column, tag: Column, kind: Column) -> Column:
    """The explicit role, or what the tag and input type imply."""
    tag, kind = F.lower(tag), F.lower(F.coalesce(kind, F.lit("text")))
    given = cleaned(explicit)
    return (
        F.when(given != "", given)
        .when(tag == "input", F.when(kind.isin("checkbox", "radio"), kind).otherwise("textbox"))
        .when(tag == "textarea", "textbox")
        .when(tag == "button", "button")
        .when(tag == "a", "link")
        .when(tag == "img", "image")
        .when(tag == "select", "combobox")
        .otherwise("text")
    )


def label_of(*fallbacks: Column) -> Column:
    """The first that is not blank, or an empty label."""
    return F.coalesce(*(F.nullif(cleaned(f), F.lit("")) for f in fallbacks), F.lit(""))


def value_of(tag: Column, value: Column, selected: Column, own_text: Column) -> Column:
    tag = F.lower(tag)
    return F.when(tag.isin("input", "textarea"), F.coalesce(value, F.lit(""))).when(tag == "select", F.coalesce(selected, F.lit(""))).otherwise(cleaned(own_text, 600))


def kept(role: Column, text: Column) -> Column:
    """Controls, and other elements with 1 to 600 characters."""
    return role.isin("button", "link", "textbox", "combobox", "checkbox", "radio", "image") | F.length(F.trim(F.coalesce(text, F.lit("")))).between(1, 600)


def input_type(kind: Column, autocomplete: Column, label: Column, inputmode: Column, maxlength: Column) -> Column:
    """password, otp (by autocomplete, label, or a numeric field of six), or null."""
    low = F.lower(F.coalesce(label, F.lit("")))
    otp = (
        (F.coalesce(autocomplete, F.lit("")) == "one-time-code")
        | low.rlike("otp|one-time")
        | ((F.coalesce(inputmode, F.lit("")) == "numeric") & (F.coalesce(maxlength, F.lit("")) == "6"))
    )
    return F.when(F.lower(F.coalesce(kind, F.lit(""))) == "password", "password").when(otp, "otp")


def enabled(disabled: Column, aria_disabled: Column) -> Column:
    return ~(F.coalesce(disabled, F.lit(False)) | (F.coalesce(aria_disabled, F.lit("")) == "true"))


def origin(url: Column) -> Column:
    """scheme://host[:port] of an http or https address, without user info and the scheme's own port; null for others."""
    part = lambda k: F.lower(F.regexp_extract(url, r"^\s*(?i:(https?)://(?:[^/?#@]*@)*([^/?#:@\[\]\s]+|\[[0-9A-Fa-f:.]+\])(?::0*(\d*))?(?=[/?#\s]|$))", k))
    scheme, port = part(1), part(3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), part(2), F.when(usual, "").otherwise(F.concat(F.lit(":"), port))))


def same_origin(target: Column, page_url: Column) -> Column:
    """Relative addresses and those of the page's origin; other schemes never."""
    scheme = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    away = F.startswith(target, F.lit("//"))
    return F.when(target.isNull() | ((scheme == "") & ~away), True).otherwise(
        F.coalesce(origin(F.when(away, F.concat(F.lit("http:"), target)).otherwise(target)) == origin(page_url), F.lit(False))
    )


def first_of_each(elements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the given order; not any row, as dropDuplicates would keep. Rows combine on the map
    side, so that a key that many rows share lands in no task with all of them."""
    rest = [c for c in elements.columns if c not in keys]
    first = elements.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in elements.columns))


def deduplicated(elements: DataFrame) -> DataFrame:
    """Elements of a page with the same tag, box and first 40 characters count once."""
    e = elements.withColumn("_head", F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return first_of_each(e, ["page_id", "tag", "box", "_head"], ["ord"]).drop("_head")


def ui_class(x: str = "") -> Column:
    """The class of a contour from its features: w, h, mean_b, mean_g, mean_r, std, ink, centroid, dark_ink; null: none."""
    # The thresholds below are fixed values.
    c = lambda n: F.col(f"{x}{n}")
    mean = (c("mean_b") + c("mean_g") + c("mean_r")) / 3
    ratio = c("w") / c("h")
    flat = (ratio > 1.6) & (ratio < 10.0) & (c("h") > 26) & (c("h") < 72) & (mean > 170)
    centred = F.abs(c("centroid") - 0.5) < 0.20
    return (
        F.when((mean < 140) & (ratio > 1.8) & (ratio < 7.5) & (c("h") > 28) & (c("h") < 70), "button")
        .when((c("w") > 110) & (c("h") > 110) & (c("std") < 48), "image_region")
        .when(
            flat,
            F.when(c("mean_g") > c("mean_b") + 3, "status_block")
            .when(centred & (c("dark_ink") < 120) & (c("ink") > 0.02) & (c("w") < 220), "button")
            .when((c("ink") < 0.035) | (c("dark_ink") > 135), "input")
            .otherwise("value_chip"),
        )
    )


def decoded_anchor(v: Column, n_classes: int, scale: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A detector's row (centre x, y, width, height, class scores) as struct<cls, score, box> on the screenshot.

    Letterboxing is undone and the box clamped; null for scores under 0.30 and boxes under 4 pixels.
    """
    scores = F.slice(v, 5, n_classes)
    best = F.array_max(scores)
    clamp = lambda x, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), x))
    at = lambda i: F.element_at(v, i).cast("double")
    box = F.struct(
        clamp((at(1) - at(3) / 2 - dx) / scale, width).alias("x1"),
        clamp((at(2) - at(4) / 2 - dy) / scale, height).alias("y1"),
        clamp((at(1) + at(3) / 2 - dx) / scale, width).alias("x2"),
        clamp((at(2) + at(4) / 2 - dy) / scale, height).alias("y2"),
    )
    fine = (best >= 0.30) & (box["x2"] - box["x1"] >= 4) & (box["y2"] - box["y1"] >= 4)
    return F.when(fine, F.struct((F.array_position(scores, best) - 1).cast("int").alias("cls"), best.cast("double").alias("score"), box.alias("box")))
