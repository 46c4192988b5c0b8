"""Mixing by soft membership: document rates whose expected domain totals match target weights.

Domains are classes of a labelled table. A naive Bayes model over hashed word n-grams, fitted on one half of the labelled
sample, scores every document; a softmax regression fitted on the other half's scores turns scores into posteriors. The
rates r, nonnegative and bounded, minimise A r - t, where A holds each document's posteriors times its tokens and t the
target totals, in the metric that whitens the domains: scaled projected gradient, each step one aggregate over all documents that returns a few numbers per domain.
A rate follows from the posteriors and the steps' gradients alone, so no rates are stored between steps.

Tokens are words (maximal runs of characters other than white space). Scale: two scans of the texts, then aggregates over
(tokens, posteriors); nothing is shuffled but sums. The classifier's sample has at most `max_labelled` rows (those with the
smallest hashes of their ids), which are broadcast; it is halved by the hash as well. Ids of any type are compared by a
64-bit hash of their text.

Defined cases: a null or empty text has no tokens and the posteriors of a text without evidence; rows with a null id or
label are no examples; repeated rows count as often as they stand; without labels all posteriors are equal; an empty table
gives no rows; columns of docs other than those asked for are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm import scratch
from quire.llm.quality import features
from quire.llm.words import Texts, lean, pieces, sums

BUCKETS = 1 << 13
MAX_LABELLED = 50_000
FIXED = 1 << 24
STEPS = 24
RIDGE = 0.02
MAX_RATE = 8.0
# The domains of the labelled table and the share of the mix each is to have.
DOMAINS = {"good": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
WEIGHTS = {"good": 0.82, "poor": 0.10, "toxic": 0.08}


def _sample(labels: DataFrame, id_col: str, domains: dict[str, str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ids in order, and the number of each one's domain. An id with two labels counts with the first domain."""
    number = reduce(lambda c, kv: c.when(F.expr(kv[1]), kv[0]), list(enumerate(domains.values()))[1:], F.when(F.expr(next(iter(domains.values()))), 0))
    rows = labels.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("k"), number.cast("int").alias("c")).where("c is not null").groupBy("k").agg(F.min("c").alias("c"))
    got = rows.orderBy("k").limit(most).toPandas().sort_values("k")
    return got["k"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


def _classes(col: pa.Array, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The domain of each id, -1 where it is not in the sample."""
    key = col.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
    return np.where((ids[at] == key) & col.is_valid().to_numpy(zero_copy_only=False), classes[at], -1)


def _softmax(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the scores, weights and biases of a regression on them."""
    if not len(y):
        return np.zeros(k), np.ones(k), np.zeros((k, k)), np.zeros(k)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, t = (x - mean) / scale, np.eye(k)[y]
    w, b = np.zeros((k, k)), np.log((t.sum(0) + 1) / (len(y) + k))
    for _ in range(400):
        p = np.exp(z @ w + b - (z @ w + b).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (z.T @ (p - t) / len(y) + 1e-4 * w)
        b -= 0.5 * (p - t).mean(0)
    return mean, scale, w, b


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", domains: dict[str, str] | None = None, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, keep: list[str] | None = None) -> DataFrame:
    """given (a struct of the columns kept), n_tokens, posterior (one double per domain), as a written table."""
    domains = domains or DOMAINS
    spark, k = docs.sparkSession, len(domains)
    ids, classes = _sample(labels, id_col, domains, max_labelled)
    held = spark.sparkContext.broadcast((ids, classes))
    slim = docs.select(F.struct(*[F.col(c) for c in (keep or [id_col])]).alias("given"), F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).alias("key"), F.col(text).alias("body"))

    def count(batches):
        ids, classes = held.value
        n = np.zeros((k, buckets), np.int64)
        for batch in batches:
            own = _classes(batch.column("key"), ids, classes)
            own[batch.column("key").fill_null(0).to_numpy(zero_copy_only=False) % 2 == 1] = -1
            some = batch.filter(pa.array(own >= 0))
            own = own[own >= 0]
            for a, b in pieces(some, "body"):
                t = Texts(some.column("body").slice(a, b - a), lower=True)
                one, two, inside = features(t.word_hashes(), t.first, t.last, buckets)
                c = np.repeat(own[a:b], t.count)
                np.add.at(n, (c, one), 1)
                np.add.at(n, (c[: len(two)][inside], two[inside]), 1)
        c, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(n[c, b])], names=["c", "b", "n"])

    table = np.ones((k, buckets))
    for r in slim.select("key", "body").mapInArrow(lean(count), "c long, b long, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).toPandas().itertuples():
        table[r.c, r.b] += r.n
    logs = np.log(table / table.sum(1, keepdims=True))
    model = spark.sparkContext.broadcast(np.rint((logs - logs.mean(0)) * FIXED).astype(np.int64))

    def score(batches):
        ids, classes = held.value
        for batch in batches:
            own = _classes(batch.column("key"), ids, classes)
            for a, b in pieces(batch, "body"):
                t = Texts(batch.column("body").slice(a, b - a), lower=True)
                h = t.word_hashes()
                one, two, inside = features(h, t.first, t.last, buckets)
                out = np.zeros((t.n, k))
                for c in range(k):
                    pair = np.zeros(len(h), np.int64)
                    pair[: len(two)] = np.where(inside, model.value[c][two], 0)
                    out[:, c] = (sums(model.value[c][one], t.first, t.last) + sums(pair, t.first, t.last)) / FIXED / np.maximum(2 * t.count - 1, 1)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("given").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(own[a:b]), pa.array(t.count), rows], names=["given", "key", "domain", "n_tokens", "score"])

    schema = StructType([slim.schema["given"], *StructType.fromDDL("key long, domain long, n_tokens long, score array<double>").fields])
    scored = scratch.write(slim.mapInArrow(lean(score), schema), "scores")
    # at most max_labelled rows, but for repeated ids, which are taken once
    other = scored.where("domain >= 0 and key % 2 <> 0").groupBy("key").agg(F.min("domain").alias("domain"), F.min("score").alias("score")).toPandas().sort_values("key")
    x = np.array(other["score"].tolist(), float).reshape(-1, k)
    mean, scale, w, b = _softmax(x, other["domain"].to_numpy(np.int64), k)
    z = [reduce(lambda s, i: s + (F.col("score")[i] - float(mean[i])) * float(w[i, c] / scale[i]), range(k), F.lit(float(b[c]))) for c in range(k)]
    top = F.greatest(*z) if k > 1 else z[0]
    e = F.transform(F.array(*z), lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return scored.select("given", "n_tokens", F.transform(e, lambda v: F.round(v / total, 9)).alias("posterior"))


def rates(members: DataFrame, weights: list[float], total: float | None = None, min_rate: float = 0.0, max_rate: float = MAX_RATE, steps: int = STEPS, tolerance: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """members with column rate in [min_rate, max_rate], and the totals reached.

    total: tokens of the mix, those of members unless given. A target below what min_rate alone gives is raised to that.
    Each step takes the gradient a little ahead of the rates, scales it by the Gram matrix of the domains (with a ridge),
    under which a full step is never too long, and projects the rates back onto their bounds.
    """
    k = len(weights)
    start = min(max(1.0, min_rate), max_rate)
    moves: list[np.ndarray] = []

    def held(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after the steps so far, and the point, ahead of them, at which the next gradient is taken."""
        r = ahead = np.full(len(p), start)
        t = 1.0
        for g in moves:
            before, r = r, np.clip(ahead - (p * g).sum(1), min_rate, max_rate)
            last, t = t, (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead = r + (last - 1) / t * (r - before)
        return r, ahead

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("posterior").flatten().to_numpy().reshape(-1, k)

    def total_of(batches):
        got = np.zeros(2 * k + k * k)
        for batch in batches:
            p, n = rows(batch), batch.column("n_tokens").to_numpy().astype(float)[:, None]
            r = held(p)[1][:, None]
            got += np.concatenate([(n * p * r).sum(0), (n * p).sum(0), ((n * p).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=[f"s{i}" for i in range(len(got))])

    def rated(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(held(rows(batch))[0], 6))], names=[*batch.schema.names, "rate"])

    names = [f"s{i}" for i in range(2 * k + k * k)]
    goal, last, reached = None, None, np.zeros(k)
    for _ in range(steps):
        made = members.select("n_tokens", "posterior").mapInArrow(total_of, ", ".join(f"{x} double" for x in names))
        got = np.array(list(made.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in names]).first()))
        reached, plain, gram = got[:k], got[k : 2 * k], got[2 * k :].reshape(k, k)
        if goal is None:
            goal = np.array(weights) / sum(weights) * (float(plain.sum()) if total is None else total)
            goal = np.maximum(goal, min_rate * plain)
        left = reached - goal
        size = float(np.abs(left).max()) / max(float(goal.sum()), 1.0)
        if not plain.sum() or size < tolerance or last is not None and abs(last - size) < tolerance:
            break
        last = size
        moves = [*moves, np.linalg.solve(gram + np.eye(k) * (RIDGE * np.trace(gram) / k + 1e-9), left)]
    schema = StructType([*members.schema.fields, *StructType.fromDDL("rate double").fields])
    return members.mapInArrow(rated, schema), reached.tolist()


def totals(mixed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """domain, tokens, reached: expected tokens of each domain before the mix and with the rates found.

    Steps are bounded and targets may be out of reach of the bounds: this says how near the mix comes to them.
    """
    names = names or list(DOMAINS)
    each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("domain"), F.col("posterior").alias("p"))).alias("x")
    parts = mixed.select("n_tokens", "rate", each).select(F.col("x.domain").alias("domain"), (F.col("x.p") * F.col("n_tokens")).alias("t"), "rate")
    return parts.groupBy("domain").agg(F.sum("t").alias("tokens"), F.sum(F.col("t") * F.col("rate")).alias("reached"))


def copies(seed: list[str]):
    """How often a document is in the mix: its rate rounded up or down by a fixed hash of the columns."""
    u = F.pmod(F.xxhash64(*seed), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(F.col("rate") + u).cast("long")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None, total_factor: float = 1.0, min_rate: float = 0.0, max_rate: float = MAX_RATE, keep: list[str] | None = None, **model) -> DataFrame:
    """given, n_tokens, posterior, rate, copies of every document."""
    weights = weights or WEIGHTS
    members = scratch.write(posteriors(docs, labels, id_col, text, keep=keep, **model), "posteriors")
    tokens = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    out, _ = rates(members, list(weights.values()), float(tokens) * total_factor, min_rate, max_rate)
    return out.withColumn("copies", copies([f"given.`{id_col}`"]))
