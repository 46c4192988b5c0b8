"""Column functions over the text of words and lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
NUMERIC = r"^[-+(]?[$€£#]?[0-9][0-9,.\-/:%)]*$"
CONFUSABLE = "OoQDIlLiSsZzBGgqT|"
TALL = "bdfhklt!?/()[]{}#$%&@|'\""


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def despace(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)\s+", "")


def squeeze(t: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def digits(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^0-9]", ""))


def numeric_like(t: Column) -> Column:
    """At least one digit, and digits are half of the characters besides spaces."""
    inner = F.length(F.replace(strip(t), F.lit(" "), F.lit("")))
    return (F.length(strip(t)) > 0) & (digits(t) >= 1) & (2 * digits(t) >= inner)


def number_format(t: Column) -> Column:
    """The format of a written number (P10)."""
    return t.rlike(NUMERIC)


def confusable(t: Column) -> Column:
    """Has a character that is easily read as another."""
    return t.rlike(_class(CONFUSABLE))


def has_ascender(t: Column) -> Column:
    return t.rlike("[A-Z0-9]|" + _class(TALL))


def bgr_hex(b: Column, g: Column, r: Column) -> Column:
    """#rrggbb (P14)."""
    two = lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def hex_part(c: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of #rrggbb."""
    return F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("long")


def luminance_milli(b: Column, g: Column, r: Column) -> Column:
    """1000 times .114 B + .587 G + .299 R, as an integer."""
    return 114 * b + 587 * g + 299 * r


def font_size(baseline: Column, top5: Column, top_median: Column, ascender: Column) -> Column:
    """Font size from ink: 4 at least."""
    return F.greatest(F.lit(4.0), F.when(ascender, (baseline - top5) / 0.72).otherwise((baseline - top_median) / 0.53))


def html_escape(t: Column) -> Column:
    """The five characters that HTML escapes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def splice(t: Column, at: Column, n: Column, new: Column) -> Column:
    """t with n characters from place `at` (0 first) replaced, squeezed."""
    return squeeze(F.concat(F.substring(t, F.lit(1), at), new, F.substring(t, at + n + 1, F.length(t))))


def seed(a: Column) -> Column:
    """A number from the first eight hex digits of the SHA-1."""
    return F.conv(F.substring(F.sha1(a), 1, 8), 16, 10).cast("long")


def base_name(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


@F.pandas_udf(StringType())
def nfkc(t):
    """Unicode NFKC; Spark has no function for it."""
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
