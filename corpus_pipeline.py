"""A corpus pipeline of five stages: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. run() writes each stage's rows
and reads them again for the next. Clean documents stay: rates of the mixing stage are 1 or more, so it repeats documents
of scarce domains and drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, neardup, packing, pii, quality, scratch
from quire.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Fixed values, not to be fitted to the tables; README says how near the mix comes to them.
WEIGHTS = {"good": 0.93, "poor": 0.02, "toxic": 0.05}
TOTAL_FACTOR = 1.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    return quality.assess(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; documents without words all stay."""
    rows = scratch.write(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = neardup.near_duplicates(rows.select(F.struct("doc_id", "row").alias("at"), "text"), id_col="at")
    gone = found.where(~F.col("kept")).select(F.col("at.row").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    made = pii.replace(docs.select(*COLUMNS), pii.session_key(spark))
    return made.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, at least once."""
    made = mixing.mix(docs, table(spark, sf_dir, "labels"), weights=WEIGHTS, total_factor=TOTAL_FACTOR, min_rate=1.0, keep=COLUMNS)
    each = made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1).cast("long")))))
    return each.select(*[F.col(f"given.{c}").alias(c) for c in COLUMNS])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), digest=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_domains", mix_domains),
    ("pack_sequences", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
