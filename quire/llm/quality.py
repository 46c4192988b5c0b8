"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed word n-grams (one and two words, lower-cased) are estimated with add-one smoothing: one from
trusted texts, one from the whole corpus. A text's score is the mean over its n-grams of log p_trusted - log p_raw, so
long and short texts compare; scores are sums of fixed-point integers and do not depend on how rows are batched.

Scale: one scan counts (a task sends at most one row per bucket), one scan scores; no text is shuffled. The trusted model
is fitted on at most `max_trusted` labelled rows (those with the smallest hashes of their ids); the raw model and the
decisions cover every row. Ids of any type are compared by a 64-bit hash of their text.

Defined cases: a null text counts as empty; a text without words has score 0 and fails the base rule; a null label is not
trusted; a repeated row or id is counted and scored as often as it stands; without trusted rows every score is 0; an empty
table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import Texts, U, block_hashes, grams, lean, mix, pieces, sums

BUCKETS = 1 << 14
THRESHOLD = -0.08
MAX_TRUSTED = 200_000
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
FIXED = 1 << 24
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True


def features(h: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, and of all pairs of neighbouring words; whether the pair that starts at a word is inside its text."""
    one = (h % U(buckets)).astype(np.int64)
    two = (grams(h, 2) % U(buckets)).astype(np.int64)
    inside = np.ones(len(two), bool)
    ends = last[last > first] - 1
    inside[ends[ends < len(two)]] = False
    return one, two, inside


def _repeats(h: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Per text, its words that lie in windows of n words which the text has twice or more."""
    windows = grams(h, n)
    out = np.zeros(len(first), np.int64)
    if not len(windows):
        return out
    owner = np.repeat(np.arange(len(first)), last - first)[: len(windows)]
    valid = np.arange(len(windows)) + n <= last[owner]
    at = np.flatnonzero(valid)
    key = mix(windows[at] + mix(owner[at].astype(U)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + n, -1)
    return sums(np.cumsum(cover[:-1]) > 0, first, last)


def _dup_lines(t: Texts) -> np.ndarray:
    """Per text, its \\n-split lines with a word that equal an earlier line of it."""
    cut = np.flatnonzero(t.data == 10)
    start = np.union1d(t.off[:-1][t.off[1:] > t.off[:-1]], cut + 1)
    start = start[start < len(t.data)]
    stop = np.searchsorted(cut, start)
    end = np.append(cut, len(t.data))[stop] if len(start) else start
    owner = np.searchsorted(t.off, start, "right") - 1
    end = np.minimum(end, t.off[owner + 1])
    words = np.searchsorted(t.starts, end) - np.searchsorted(t.starts, start)
    keep = words > 0
    start, end, owner = start[keep], end[keep], owner[keep]
    key = mix(block_hashes(t.data, start, end) + mix(owner.astype(U)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return np.bincount(owner[order[1:]][same], minlength=t.n)


def _counts(id_col: str, text: str, trusted, buckets: int):
    def run(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        ids = trusted.value
        for batch in batches:
            for a, b in pieces(batch, text):
                part = batch.slice(a, b - a)
                t = Texts(part.column(text), lower=True)
                h = t.word_hashes()
                one, two, inside = features(h, t.first, t.last, buckets)
                raw += np.bincount(one, minlength=buckets) + np.bincount(two[inside], minlength=buckets)
                known = part.column(id_col).is_valid().to_numpy(zero_copy_only=False)
                key = part.column(id_col).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
                chosen = known & (ids[at] == key) if len(ids) else np.zeros(len(key), bool)
                flag = np.repeat(chosen, t.count)
                good += np.bincount(one[flag], minlength=buckets)
                good += np.bincount(two[inside & flag[: len(two)]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", trusted: str = "quality = 1 and toxic = 0", buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """Fixed-point log ratio of each bucket. Ids of trusted rows: at most max_trusted, 8 bytes each, are broadcast."""
    spark = docs.sparkSession
    ids = labels.where(F.expr(trusted) & F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("k")).distinct()
    chosen = ids.orderBy("k").limit(max_trusted).toPandas()["k"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(np.sort(chosen))
    slim = docs.select(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).alias("k"), F.col(text).alias("t"))
    rows = slim.mapInArrow(lean(_counts("k", "t", held, buckets)), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"].to_numpy(np.int64)] = rows["raw"]
    good[rows["bucket"].to_numpy(np.int64)] = rows["good"]
    if not good.sum():
        return np.zeros(buckets, np.int64)
    ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    return np.rint(ratio * FIXED).astype(np.int64)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def measures(col: pa.Array, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[pa.Array]:
    """The columns of SCHEMA for some texts."""
    t = Texts(col)
    inside = t.inner
    chars = t.per_text(inside & ((t.data & 0xC0) != 0x80))
    symbols = t.per_text(_SYMBOL[t.data])
    lines = _dup_lines(t)
    h = t.word_hashes()
    repeat = _repeats(h, t.first, t.last, WINDOW)
    low = Texts(col, lower=True)
    one, two, inner = features(low.word_hashes(), low.first, low.last, len(ratio))
    total = sums(ratio[one], t.first, t.last)
    pair = np.zeros(len(h), np.int64)
    pair[: len(two)] = np.where(inner, ratio[two], 0)
    total += sums(pair, t.first, t.last)
    n = np.maximum(2 * t.count - 1, 1)
    score = total / FIXED / n
    failed = (t.count < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * t.count)
    # compared as integers, so that the verdict is the same on every machine
    kept = ~failed & (total >= np.rint(threshold * FIXED).astype(np.int64) * n)
    return [pa.array(x) for x in (t.count.astype(np.int64), chars, symbols, lines.astype(np.int64), repeat, failed, score, kept)]


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, **model) -> DataFrame:
    """A row per row of docs: the id (or the columns of keep), then SCHEMA."""
    ratio = fit(docs, labels, id_col, text, **model)
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    given = keep or [id_col]
    source = docs.select(F.struct(*[F.col(c) for c in given]).alias("given"), F.col(text).alias("measured"))

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch, "measured"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("given"), *measures(part.column("measured"), held.value, threshold)], names=names)

    from pyspark.sql.types import StructField, StructType

    names = ["given", *[x.split()[0] for x in SCHEMA.split(", ")]]
    schema = StructType([source.schema["given"], *[StructField(f.name, f.dataType) for f in StructType.fromDDL(SCHEMA)]])
    out = source.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"given.`{c}`") for c in given], *names[1:])
