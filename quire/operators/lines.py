"""Lines from words, engine readings, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values, in hundredths.
LINE_LOW, WORD_LOW, CHAR_UNCLEAR, SECOND_OPINION, SECOND_CHAR, AMBIGUOUS = 85, 80, 60, 95, 85, 97


def lines(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Text, box, mean and least confidence of each line (P25, A2, A3, A4)."""
    keys = keys or ["doc_id", "line_no"]
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "word")))
    return words.groupBy(*keys).agg(
        F.concat_ws(" ", F.transform(ordered, lambda w: w["word"])).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("n_words"), F.sum("conf_pct").alias("conf_sum"), F.min("conf_pct").alias("conf_min"),
    )


def page_stats(lines: DataFrame) -> DataFrame:
    """Per document: lines, words, lines of low confidence, mean confidence of lines in percent (A1)."""
    mean = F.col("conf_sum") / F.col("n_words")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_words").alias("n_words"), F.count_if(F.col("conf_sum") < LINE_LOW * F.col("n_words")).alias("low_lines"), F.min("conf_min").alias("conf_min"), F.max(F.floor(mean)).alias("best_mean"))


def needs_second_opinion(text: Column, conf: Column, least: Column) -> Column:
    """Low confidence of the line or of a character, or a number with a confusable character (F2)."""
    return (conf < SECOND_OPINION) | (least < SECOND_CHAR) | (T.numeric_like(text) & T.confusable(text))


def reconcile(r: DataFrame) -> DataFrame:
    """verdict, text, conf and n_alternatives of three engines' readings t0 c0 t1 c1 t2 c2, in this order."""
    t = [F.col(f"t{k}") for k in range(3)]
    c = [F.col(f"c{k}") for k in range(3)]
    false = lambda x: F.coalesce(x, F.lit(False))
    same = lambda a, b: false((a == b) | (T.despace(a) == T.despace(b)))  # noqa: E731  texts that are equal need no pattern
    filled = lambda x: false(F.length(T.despace(x)) > 0)
    own = r.columns
    confirmed, corrected, numeric = F.col("_confirmed"), F.col("_corrected"), F.col("_numeric")
    # one projection for each decision: a later one costs nothing where an earlier one holds
    a = r.select("*", same(t[1], t[0]).alias("_s1"), same(t[2], t[0]).alias("_s2"))
    a = a.select("*", (F.col("_s1") | F.col("_s2")).alias("_confirmed"))
    a = a.select("*", (~confirmed & false(t[1].isNotNull() & t[2].isNotNull()) & same(t[1], t[2]) & filled(t[1])).alias("_corrected"))
    undecided = ~confirmed & ~corrected
    ok = [false(T.number_format(F.replace(x, F.lit(" "), F.lit("")))) for x in t]
    a = a.select("*", *[(undecided & ok[k]).alias(f"_f{k}") for k in (1, 2)], *[(false(t[k].isNotNull()) & ~F.col(f"_s{k}") & filled(t[k])).cast("long").alias(f"_d{k}") for k in (1, 2)])
    a = a.select("*", ((F.col("_f1") | F.col("_f2")) & false(T.numeric_like(t[0])) & ~ok[0]).alias("_numeric"))
    second = F.col("_f1") & (~F.col("_f2") | (c[1] >= c[2]))
    others = F.col("_d1") + F.col("_d2")
    verdict = F.when(confirmed, "confirmed").when(corrected, "corrected").when(numeric, "numeric_context").when(others > 0, "disagreement").otherwise("single")
    text = F.when(confirmed, t[0]).when(corrected, t[1]).when(numeric, F.when(second, t[1]).otherwise(t[2])).otherwise(t[0])
    conf = F.when(confirmed, c[0]).when(corrected, F.least(c[1], c[2])).when(numeric, F.when(second, c[1]).otherwise(c[2])).otherwise(c[0])
    there = t[1].isNotNull().cast("long") + t[2].isNotNull().cast("long")
    alternatives = F.when(corrected, F.lit(1).cast("long")).when(numeric, there).otherwise(others)
    return a.select(*own, verdict.alias("verdict"), text.alias("text"), conf.alias("conf"), alternatives.alias("n_alternatives"))


def raised_confidence(verdict: Column, own: Column, best: Column, chosen: Column) -> Column:
    """Confidence after reconciling, in percent: confirmed ones rise to the best, 97 at most."""
    return F.when(verdict == "confirmed", F.greatest(own, F.least(F.lit(97), best))).when(verdict.isin("corrected", "numeric_context"), chosen).otherwise(own)


def word_flags(words: DataFrame, lines: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Flags (doc_id, line_no, type, word_no): low confidence, ambiguous numbers, engine disagreement (§2.12)."""
    low = lines.where(F.col("conf_sum") < LINE_LOW * F.col("n_words")).select("doc_id", "line_no", F.lit("low_confidence").alias("type"), F.lit(None).cast("long").alias("word_no"))
    fine = lines.where(F.col("conf_sum") >= LINE_LOW * F.col("n_words")).select("doc_id", "line_no")
    weak = words.where(F.col("conf_pct") < WORD_LOW).join(fine, ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", F.lit("low_confidence").alias("type"), "word_no")
    number = words.where(T.numeric_like(F.col("word")) & T.confusable(F.col("word")) & (F.col("conf_pct") < AMBIGUOUS)).select("doc_id", "line_no", F.lit("ambiguous_number").alias("type"), "word_no")
    out = low.unionByName(weak).unionByName(number)
    if readings is not None:
        disputed = reconcile(readings).where(F.col("verdict").isin("disagreement", "corrected", "numeric_context")).select("doc_id", "line_no", F.lit("engine_disagreement").alias("type"), "word_no")
        out = out.unionByName(disputed)
    return out


DISPUTED = ("disagreement", "corrected", "numeric_context")


def flagged_lines(marked: DataFrame) -> DataFrame:
    """doc_id, line_no, n_words, words (numbers in order) and flags (type, word_no) of each line: word_flags in one shuffle.

    marked: words with conf_pct and, where engines were compared, verdict.
    """
    c, t = F.col("conf_pct"), F.col("word")
    number = T.confusable(t) & (c < AMBIGUOUS) & T.numeric_like(t)
    disputed = F.col("verdict").isin(*DISPUTED) if "verdict" in marked.columns else F.lit(False)
    each = F.struct("word_no", (c < WORD_LOW).alias("weak"), number.alias("number"), disputed.alias("disputed"))
    lines = marked.select("doc_id", "line_no", "conf_pct", each.alias("w")).groupBy("doc_id", "line_no").agg(F.sum("conf_pct").alias("conf_sum"), F.count(F.lit(1)).alias("n_words"), F.array_sort(F.collect_list("w")).alias("ws"))
    flag = lambda kind, no: F.struct(F.lit(kind).alias("type"), no.alias("word_no"))
    of = lambda kind, field: F.transform(F.filter("ws", lambda w: F.coalesce(w[field], F.lit(False))), lambda w: flag(kind, w["word_no"]))
    low = F.when(F.col("conf_sum") < LINE_LOW * F.col("n_words"), F.array(flag("low_confidence", F.lit(None).cast("long")))).otherwise(of("low_confidence", "weak"))
    flags = F.concat(low, of("ambiguous_number", "number"), of("engine_disagreement", "disputed"))
    return lines.select("doc_id", "line_no", "n_words", F.transform("ws", lambda w: w["word_no"]).alias("words"), flags.alias("flags"))


def first_flags(flags: DataFrame, order: list[str]) -> DataFrame:
    """The first flag of each line and type."""
    w = Window.partitionBy("doc_id", "line_no", "type").orderBy(*order)
    return flags.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
