"""Layout tables derived from the text tables: the same integers in every engine.

Each text line is cut into visual lines of 12 words; a character is 10 px wide, a line 18 px high and 24 px apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRAP = 12
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are small: a file of one row group is else one task's. Larger inputs have groups enough."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, ws: each visual line with its words as an array of (word_no, word, off, n). No shuffle: an offset is the length of a line's words before it.

    A text line of over 12,000 words runs into the next one's numbers; these are two rows of one line_no.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("text_line", "line"))
    inner = docs.withColumn("line", F.trim("line")).where("line <> ''").select("doc_id", "text_line", F.split("line", " +").alias("ws"))
    cut = F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / WRAP).cast("int"))
    lines = inner.select("doc_id", "text_line", "ws", F.explode(cut).alias("v")).select("doc_id", (F.col("text_line") * 1000 + F.col("v")).cast("long").alias("line_no"), F.slice("ws", F.col("v") * WRAP + 1, F.lit(WRAP)).alias("ws"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice("ws", F.lit(1), i), " ")) + 1)
    placed = F.transform("ws", lambda w, i: F.struct(i.cast("long").alias("word_no"), w.alias("word"), before(i).cast("long").alias("off"), F.length(w).cast("long").alias("n")))
    return lines.select("doc_id", "line_no", placed.alias("ws"))


def confidence(word_no: Column, n: Column) -> Column:
    """conf_pct of a word of n characters, beside doc_id and line_no."""
    return (F.col("doc_id") * 31 + F.col("line_no") * 17 + word_no * 7 + n) % 100


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, word_no, word, x0, y0, x1, y1, conf_pct. No shuffle of words."""
    w = placed_lines(spark, sf_dir).select("doc_id", "line_no", F.inline("ws"))
    return w.select(
        "doc_id", "line_no", "word_no", "word",
        (F.col("off") * 10).alias("x0"), (F.col("line_no") * 24).alias("y0"),
        ((F.col("off") + F.col("n")) * 10).alias("x1"), (F.col("line_no") * 24 + 18).alias("y1"),
        confidence(F.col("word_no"), F.col("n")).alias("conf_pct"),
    )


WORDS_SQL = """
WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
li AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS text_line FROM ls),
wl AS (SELECT doc_id, text_line, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM li),
wi AS (SELECT doc_id, text_line, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM wl),
wv AS (SELECT doc_id, (text_line * 1000 + k // 12)::BIGINT AS line_no, (k % 12)::BIGINT AS word_no, word FROM wi),
wo AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM wv),
words AS MATERIALIZED (SELECT doc_id, line_no, word_no, word, 10 * off AS x0, 24 * line_no AS y0, 10 * (off + length(word)) AS x1, 24 * line_no + 18 AS y1,
 (doc_id * 31 + line_no * 17 + word_no * 7 + length(word)) % 100 AS conf_pct FROM wo)"""


def reading(word: Column, word_no: Column, conf: Column) -> dict[str, Column]:
    """Three engines' texts and confidences of a word, beside doc_id and line_no: t0 c0 t1 c1 t2 c2. An absent engine has a null text."""
    m = (F.col("doc_id") * 7 + F.col("line_no") * 5 + word_no * 3) % 10
    n = F.length(word).cast("long")
    number = lambda c: F.concat((n * 37).cast("string"), F.lit(c), word_no.cast("string"))
    swapped = F.translate(word, "eo", "30")
    t1 = F.when(m.isin(0, 1, 2, 4), swapped).when(m == 5, F.lit(None)).when(m == 6, number("0")).otherwise(word)
    t2 = F.when(m.isin(0, 1), swapped).when(m.isin(3, 4), F.replace(word, F.lit("t"), F.lit(""))).when(m == 5, F.lit("")).when(m == 6, number("Q")).otherwise(word)
    t0 = F.when(m == 6, number("O")).otherwise(word)
    return {"t0": t0, "c0": conf, "t1": t1, "c1": (conf + 11) % 100, "t2": t2, "c2": (conf + 23) % 100}


def readings(w: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Three engines' readings of each word, wide, beside the columns to keep."""
    r = reading(F.col("word"), F.col("word_no"), F.col("conf_pct"))
    return w.select("doc_id", "line_no", "word_no", *(keep or []), *[c.alias(name) for name, c in r.items()])


READINGS_SQL = WORDS_SQL + """,
rm AS (SELECT *, (doc_id * 7 + line_no * 5 + word_no * 3) % 10 AS m, (length(word) * 37)::VARCHAR AS num FROM words),
readings AS (SELECT doc_id, line_no, word_no,
 CASE WHEN m = 6 THEN num || 'O' || word_no ELSE word END AS t0, conf_pct AS c0,
 CASE WHEN m IN (0, 1, 2, 4) THEN translate(word, 'eo', '30') WHEN m = 5 THEN NULL WHEN m = 6 THEN num || '0' || word_no ELSE word END AS t1, (conf_pct + 11) % 100 AS c1,
 CASE WHEN m IN (0, 1) THEN translate(word, 'eo', '30') WHEN m IN (3, 4) THEN replace(word, 't', '') WHEN m = 5 THEN '' WHEN m = 6 THEN num || 'Q' || word_no ELSE word END AS t2, (conf_pct + 23) % 100 AS c2 FROM rm)"""
