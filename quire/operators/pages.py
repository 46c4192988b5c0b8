"""Rules on pages and files: types, paper, sizes, statuses, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Paper sizes in points, aspects in the order in which they are tried, and what to do after an error.
PAPER = (("letter", 612.0, 792.0), ("a4", 595.28, 841.89), ("legal", 612.0, 1008.0), ("a5", 419.53, 595.28))
ASPECTS = (("letter", 11 / 8.5), ("a4", 297 / 210), ("legal", 14 / 8.5), ("a5", 210 / 148))
RECOVERY = (("timeout", "retry_fast"), ("timeout", "manual"), ("ocr_failed", "retry"), ("ocr_failed", "manual"), ("ocr_unavailable", "retry"), ("ocr_unavailable", "manual"))
HEIC = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "heim", "heis")
MAX_BYTES = 80 * 1024 * 1024
MAX_TEXT = 500


def mime(head: Column) -> Column:
    """Media type by the first bytes, given as upper-case hex; null if none is known."""
    at = lambda k, n: F.substring(head, 2 * k + 1, 2 * n)
    code = lambda s: F.lit(s.encode("latin-1").hex().upper())
    starts = lambda s: F.startswith(head, code(s))
    ftyp = at(4, 4) == code("ftyp")
    return (
        F.when(head.rlike("^(?:..)*?" + "%PDF".encode().hex()), "application/pdf").when(starts("\xff\xd8\xff"), "image/jpeg").when(starts("\x89PNG\r\n\x1a\n"), "image/png")
        .when(ftyp & at(8, 4).isin([b.encode().hex().upper() for b in HEIC]), "image/heic").when(ftyp & (at(8, 4) == code("avif")), "image/avif")
        .when(starts("RIFF") & (at(8, 4) == code("WEBP")), "image/webp").when(starts("II*\x00") | starts("MM\x00*"), "image/tiff").when(starts("BM"), "image/bmp")
    )


def upload_status(length: Column, kind: Column) -> Column:
    """Error code of an upload, or ok."""
    return F.when(length == 0, "empty_file").when(length > MAX_BYTES, "too_large").when(kind.isNull(), "unsupported_type").otherwise("ok")


def snap_paper(w: Column, h: Column) -> Column:
    """The first paper whose aspect is within 6 percent."""
    aspect = F.greatest(w, h) / F.least(w, h)
    out = None
    for name, a in ASPECTS:
        near = F.abs(aspect - a) / a < 0.06
        out = F.when(near, name) if out is None else out.when(near, name)
    return out


def page_size(pages: DataFrame) -> DataFrame:
    """pages (w, h, pdf_w, pdf_h, paper, dpi, rectified) with size_rule: pdf, else paper, else dpi, 200 if below 150 or rectified."""
    spark = pages.sparkSession
    paper = F.broadcast(spark.createDataFrame(list(PAPER), "paper string, pw double, ph double"))
    t = pages.join(paper, "paper", "left")
    dpi = F.when((F.coalesce("dpi", F.lit(0)) < 150) | F.col("rectified"), F.lit(200)).otherwise(F.col("dpi"))
    tall = F.col("h") >= F.col("w")
    known, onpaper = F.col("pdf_w").isNotNull(), F.col("pw").isNotNull()
    rule = F.when(known, F.lit("pdf")).when(onpaper, F.concat(F.lit("paper:"), F.col("paper"))).otherwise(F.concat(F.lit("dpi:"), dpi.cast("int").cast("string")))
    pw = F.when(known, F.col("pdf_w")).when(onpaper, F.when(tall, F.col("pw")).otherwise(F.col("ph"))).otherwise(F.col("w") * 72.0 / dpi)
    ph = F.when(known, F.col("pdf_h")).when(onpaper, F.when(tall, F.col("ph")).otherwise(F.col("pw"))).otherwise(F.col("h") * 72.0 / dpi)
    return t.withColumn("size_rule", rule).withColumn("w_pt", pw).withColumn("h_pt", ph).drop("pw", "ph")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def recovery(spark: SparkSession) -> DataFrame:
    """Error codes with their actions in order (X11)."""
    return spark.createDataFrame([(c, k, a) for k, (c, a) in enumerate(RECOVERY)], "code string, ord int, action string")


def edit_error(x0: Column, y0: Column, x1: Column, y1: Column, text: Column, w: Column, h: Column) -> Column:
    """Why an edit is refused, or ok."""
    none = x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull()
    return F.when(none, "needs_box").when(~((x1 > x0) & (y1 > y0)), "empty_region").when((x1 <= 0) | (y1 <= 0) | (x0 >= w) | (y0 >= h), "outside_page").when(F.length(text) > MAX_TEXT, "text_too_long").otherwise("ok")
