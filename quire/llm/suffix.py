"""Suffix-array removal of repeated strings: every byte in a string of `width` bytes that also starts in an earlier document.

1. Every window of `width` bytes is given to the smallest hash among its k-byte substrings, its anchor; windows of one text
   with the same anchor in a row are one segment. Equal windows have equal anchors, wherever they stand.
2. Segments are dealt by anchor, as packed arrays. Of equal segments (anchor and content) only those of the smallest id
   stay; the windows of the others are repeated as a whole. This is done in each batch of texts first, so a passage that
   stands everywhere is sent once a batch.
3. What is left with an anchor are different segments. Two of them have a window in common only if they agree on half of the
   bytes beside the anchor, left or right; those that agree so are fetched as bytes and dealt by anchor again, or, where an
   anchor has many, by the anchor and the bytes they agree on.
4. Blocks of such segments get a suffix array by two-stage sorting: suffixes smaller than their successors are sorted
   directly, all others are induced by scanning the buckets of first bytes. Common prefixes of neighbours of `width` bytes or
   more make runs of equal windows; the smallest id of a run keeps its window, the others lose theirs.
5. Spans are merged per document, judged on the input, and cut out.

Scale: two exchanges, one of about a byte per byte of text (packed segments), one of the texts with their spans. Nothing is
collected. Segments are equal if the 64-bit hashes of their bytes are, within 48 bits of their anchor's: a byte is cut wrongly
with a chance of 2^-64 for each pair of different segments of one anchor. All other windows are compared by bytes.

Defined cases: ids are integers; null texts count as empty and lose nothing; a text shorter than the width loses nothing; a null id counts as
larger than all others; rows with the same id never remove each other's bytes; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm import scratch
from quire.llm.words import Texts, U, block_hashes, lean, mix, offsets, pieces

WIDTH = 50
K = 24
CHUNK = 4 << 20
BLOCK = 1 << 20
MANY = 512
SETTLE = 12 << 20
LAST = (1 << 63) - 1

ENTRY = np.dtype([("anchor", "<u4"), ("content", "<u8"), ("left", "<u2"), ("right", "<u2"), ("row", "<u2"), ("at", "<u4"), ("n", "u1")])


# two-stage sorting


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number that orders like them; zeros follow the end."""
    d = np.concatenate([data, np.zeros(WIDTH + 16, np.uint8)]).astype(U)
    out = np.zeros(len(data) + WIDTH + 8, U)
    for k in range(8):
        out |= d[k : k + len(out)] << U(56 - 8 * k)
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the one after it; the last is not."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1:] = -1
    where = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def suffix_array(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """All suffixes in order by at least their first WIDTH bytes."""
    n = len(data)
    small = smaller_than_next(data)
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([words[direct + k] for k in range(48, -1, -8)])]
    cuts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(done: np.ndarray, own: int) -> None:
        """Sends the larger-than-next suffixes before the given ones to their buckets."""
        before = done[done > 0] - 1
        before = before[~small[before] & (data[before] > own)]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            ends = np.flatnonzero(np.diff(first[order])) + 1
            for piece in np.split(before[order], ends):
                waiting[data[piece[0]]].append(piece)

    if n:
        waiting[data[n - 1]].append(np.array([n - 1]))  # the last suffix is as if before the smallest
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        large = [now]
        while len(now):  # a run of one byte feeds its own bucket
            now = now[now > 0] - 1
            now = now[(data[now] == c) & ~small[now]]
            large.append(now)
        waiting[c] = []
        bucket = np.concatenate([*large, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        induce(bucket, c)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to 56 bytes."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for k in range(0, 56, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = x != 0
        lead = 8 - (np.frexp((x[differ] >> U(11)).astype(np.float64))[1] + 11 + 7) // 8
        low = x[differ] >> U(11) == 0
        lead[low] = 8 - (np.frexp(x[differ][low].astype(np.float64))[1] + 7) // 8
        out[live[differ] + 1] = k + lead
        live = live[~differ]
    out[live + 1] = 56
    return out


def repeated(segments: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and start of each window that also stands in a segment with a smaller id."""
    size = np.array([len(s) for s in segments])
    base = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    words = words_at(data)
    owner = np.repeat(np.arange(len(size)), size + 1)
    order = suffix_array(data, words)
    order = order[order + WIDTH <= (base + size)[owner[order]]]
    if not len(order):
        return order, order
    run = np.flatnonzero(common_prefixes(order, words) < WIDTH)
    of = ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(of, run), np.diff(np.append(run, len(order))))
    hit = order[of > least]
    return owner[hit], hit - base[owner[hit]]


# segments


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def segments(t: Texts) -> tuple[np.ndarray, ...]:
    """Starts, numbers of windows, and anchor positions of the segments of all texts."""
    n = len(t.data)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    bits = max(int(n).bit_length(), 1)
    start = np.arange(n - K + 1)
    # the hash's upper bits, then the position, so that the first of equal ones is taken
    key = t.hashes(start, start + K) >> U(bits) << U(bits) | start.astype(U)
    at = (_sliding_min(key, WIDTH - K + 1) & U((1 << bits) - 1)).astype(np.int64)
    size = np.diff(t.off)
    windows = np.maximum(size - WIDTH + 1, 0)
    first = t.off[:-1]
    valid = np.zeros(len(at) + 1, np.int64)
    live = windows > 0
    np.add.at(valid, first[live], 1)
    np.add.at(valid, first[live] + windows[live], -1)
    valid = np.cumsum(valid[:-1]) > 0
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    head[first[live]] = True
    s = np.flatnonzero(head)
    stop = np.flatnonzero(valid & np.append(head[1:] | ~valid[1:], True)) + 1
    return s, stop - s, at[s]


def _split(keys: np.ndarray) -> list[np.ndarray]:
    """Positions by key, in order of the keys."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)


MESSAGE = "part int, kind int, docs binary, body binary"
SPANS, OPEN = 0, 1


def _deal(parts: int):
    """From texts to packed segments by part, and to the spans a batch settles by itself."""

    def chunk(t: Texts, ids: np.ndarray, prints: np.ndarray):
        start, n, anchor = segments(t)
        row = np.searchsorted(t.off, start, "right") - 1
        end = start + n - 1 + WIDTH
        h, content = t.hashes(anchor, anchor + K), block_hashes(t.data, start, end)
        half = (WIDTH - K) // 2
        left, right = anchor - start >= half, end - anchor - K >= half
        a = np.where(left, anchor - half, anchor)
        b = np.where(right, anchor + K + half, anchor + K)
        side = lambda has, x, y: np.where(has, t.hashes(x, y) % U(65535) + U(1), U(0)).astype(np.uint16)
        whole = mix(h ^ mix(content))
        order = np.lexsort((ids[row], whole))
        new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]]) if len(order) else np.zeros(0, bool)
        least = ids[row][order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else ids[:0]
        late = np.zeros(len(order), bool)
        late[order] = ids[row][order] > least
        spans = np.stack([start - t.off[row], end - t.off[row]], 1)
        docs = np.stack([ids, prints], 1)
        for own in _split(row[late]):
            own = np.flatnonzero(late)[own]
            r = row[own[0]]
            yield int(prints[r] % parts), SPANS, docs[r].tobytes(), merged(spans[own]).tobytes()
        keep = np.flatnonzero(~late)
        packed = np.zeros(len(keep), ENTRY)
        k = h[keep]
        packed["anchor"], packed["content"] = k >> U(32), content[keep]
        packed["left"], packed["right"] = side(left, a, anchor)[keep], side(right, anchor + K, b)[keep]
        packed["row"], packed["at"], packed["n"] = row[keep], (start - t.off[row])[keep], n[keep]
        table = docs.tobytes()
        for own in _split((k & U(0xFFFF)) % U(parts)):
            rows, local = np.unique(packed["row"][own], return_inverse=True)
            here = packed[own]
            here["row"] = local
            yield int((k[own[0]] & U(0xFFFF)) % U(parts)), OPEN, docs[rows].tobytes() if len(rows) < len(docs) else table, here.tobytes()

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch, "body", CHUNK):
                for c in range(a, b, 60_000):
                    part = batch.slice(c, min(b, c + 60_000) - c)
                    t = Texts(part.column("body"))
                    yield message(chunk(t, part.column("doc").to_numpy(), part.column("print").to_numpy()))

    return run


def message(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "kind", "docs", "body"])


def merged(spans: np.ndarray) -> np.ndarray:
    """The spans as maximal runs: touching ones are one."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    head = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    at = np.flatnonzero(head)
    return np.stack([s[at, 0], reach[np.append(at[1:] - 1, len(s) - 1)]], 1).astype(np.int64)


def _dealt_again(key: np.ndarray, e: np.ndarray, alike: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose bytes are to be compared, and the key by which each is dealt; alike: by the left bytes, by the right ones.

    A row goes by its anchor; one of an anchor with many such rows goes by each side that it shares, so they part.
    """
    some = np.flatnonzero(alike[0] | alike[1])
    _, group, size = np.unique(key[some], return_inverse=True, return_counts=True)
    many = size[group] > MANY
    where, keys = [some[~many]], [key[some[~many]]]
    for k, (side, met) in enumerate(zip(("left", "right"), alike)):
        own = some[many & met[some]]
        where.append(own)
        keys.append(mix(key[own] ^ mix(e[side][own].astype(U) | U(k + 1) << U(16))))
    return np.concatenate(where), np.concatenate(keys)


SETTLED = "doc long, print long, kind int, body binary"


def _settle(batches):
    """From packed segments, those of a part together, to spans, and to the segments whose bytes are to be compared."""
    found, bodies, docs, size, last = [], [], [], 0, None
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = batch.slice(a, 256)
            for part, kind, d, body in zip(*[rows.column(c).to_pylist() for c in ("part", "kind", "docs", "body")]):
                d = np.frombuffer(d, np.int64).reshape(-1, 2)
                if kind == SPANS:
                    found.append((int(d[0, 0]), int(d[0, 1]), SPANS, body))
                    continue
                if size >= SETTLE and part != last:
                    yield from _settle_parts(bodies, docs)
                    bodies, docs, size = [], [], 0
                e = np.frombuffer(body, ENTRY)
                bodies.append((np.full(len(e), part, U) << U(32) | e["anchor"].astype(U), e))
                docs.append(d[e["row"]])
                size, last = size + len(body), part
        if len(found) >= 5000:
            yield settled(found)
            found = []
    yield settled(found)
    if bodies:
        yield from _settle_parts(bodies, docs)


def _settle_parts(bodies: list, docs: list):
    """What _settle gives for whole parts: keys with entries, and the documents of the entries."""
    found = []
    key = np.concatenate([b[0] for b in bodies])
    e = np.concatenate([b[1] for b in bodies])
    doc = np.concatenate(docs)
    del bodies, docs
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    several = np.zeros(len(order), bool)
    several[:-1] |= same
    several[1:] |= same
    at = order[several]
    key, e, doc = key[at], e[at], doc[at]
    content = np.ascontiguousarray(e["content"])
    order = np.lexsort((doc[:, 0], content, key))
    key, e, doc, content = key[order], e[order], doc[order], content[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    least = doc[:, 0][new][np.cumsum(new) - 1] if len(key) else doc[:, 0]
    late = doc[:, 0] > least
    start = e["at"].astype(np.int64)
    spans = np.stack([start, start + e["n"] - 1 + WIDTH], 1)
    alike = [np.zeros(len(key), bool) for _ in range(2)]
    for side, met_by in zip(("left", "right"), alike):
        own = np.flatnonzero((e[side] > 0) & ~late)
        by = own[np.lexsort((content[own], e[side][own], key[own]))]
        met = (key[by][1:] == key[by][:-1]) & (e[side][by][1:] == e[side][by][:-1])
        head = np.concatenate([[True], ~met]) if len(by) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        if len(by):
            first = np.flatnonzero(head)
            last = np.append(first[1:] - 1, len(by) - 1)
            met_by[by] = (content[by][first] != content[by][last])[group]
    number = np.unique(doc, axis=0, return_inverse=True)[1].ravel() if len(doc) else np.zeros(0, np.int64)
    where, keys = _dealt_again(key, e, alike)
    for at, kind in ((np.flatnonzero(late), SPANS), (where, OPEN)):
        for some in _split(number[at]):
            own = at[some]
            body = merged(spans[own]) if kind == SPANS else np.column_stack([keys[some].view(np.int64), spans[own]])
            found.append((int(doc[own[0], 0]), int(doc[own[0], 1]), kind, np.ascontiguousarray(body).tobytes()))
            if len(found) >= 5000:
                yield settled(found)
                found = []
    yield settled(found)


def settled(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc", "print", "kind", "body"])


FETCHED = "anchor long, doc long, print long, at long, piece binary"


def _fetch(batches):
    """The bytes of the segments to be compared: a row for each."""
    for batch in batches:
        cols = [[] for _ in range(5)]
        for doc, mark, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("doc", "print", "body", "wanted")]):
            raw = text.encode()
            rows = np.unique(np.concatenate([np.frombuffer(w, np.int64).reshape(-1, 3) for w in wanted]), axis=0)
            for key, a, b in rows.tolist():
                for c, v in zip(cols, (key, doc, mark, a, raw[a:b])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (*[pa.int64()] * 4, pa.binary()))], names=["anchor", "doc", "print", "at", "piece"])


def _compare(batches):
    """Spans of windows that the suffix arrays find in an earlier document. Rows of one anchor come together."""
    held: list[tuple] = []
    size = 0

    def flush(rows):
        doc = np.array([r[1] for r in rows], np.int64)
        which, start = repeated([r[4] for r in rows], doc)
        found = []
        for own in _split(which):
            r = rows[which[own[0]]]
            a = start[own] + r[3]
            found.append((r[1], r[2], SPANS, merged(np.stack([a, a + WIDTH], 1)).tobytes()))
        return settled(found)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc", "print", "at", "piece")]):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield flush(held)


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, and kept (the remaining bytes) of each row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(16 * n, 32_768)
    known = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    marked = known.withColumn("print", F.xxhash64("body"))
    dealt = marked.select("doc", "print", "body").mapInArrow(lean(_deal(parts)), MESSAGE).repartition(n, "part").sortWithinPartitions("part")
    first = scratch.write(dealt.mapInArrow(lean(_settle), SETTLED), "settled")
    wanted = first.where(F.col("kind") == OPEN).groupBy("doc", "print").agg(F.collect_list("body").alias("wanted"))
    fetched = marked.select("doc", "print", "body").join(wanted, ["doc", "print"]).mapInArrow(lean(_fetch), FETCHED)
    compared = fetched.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(_compare), SETTLED)
    spans = first.where(F.col("kind") == SPANS).select("doc", "print", F.col("body").alias("spans")).union(compared.select("doc", "print", "body"))
    spans = scratch.write(spans, "spans").groupBy("doc", "print").agg(F.collect_list("spans").alias("spans"))
    rows = marked.join(spans, ["doc", "print"], "left").select("given", "body", "spans")

    def cut(batches):
        for batch in batches:
            data, off = offsets(batch.column("body"))
            out = [[], [], []]
            for k, found in enumerate(batch.column("spans").to_pylist()):
                raw = data[off[k] : off[k + 1]]
                if found:
                    s = merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found]))
                    edge = np.zeros(len(raw) + 1, np.int8)
                    edge[s[:, 0]] += 1
                    edge[s[:, 1]] -= 1
                    raw = raw[np.cumsum(edge[:-1]) == 0]
                    out[0].append(int((s[:, 1] - s[:, 0]).sum()))
                    out[1].append(len(s))
                else:
                    out[0].append(0)
                    out[1].append(0)
                out[2].append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(np.diff(off)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=schema.names)

    schema = StructType([StructField("given", known.schema["given"].dataType), *StructType.fromDDL(RESULT).fields])
    return rows.mapInArrow(cut, schema).withColumnRenamed("given", id_col)
