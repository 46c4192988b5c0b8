"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing needs the lengths alone, and there are at most `capacity` of them. So the plan is made from the
histogram of lengths: lengths in falling order, each into the tightest open sequence that has room, found by a segment
tree over remaining capacities in logarithmic time; sequences that are alike are handled as one group, so the plan is
exactly that of best-fit decreasing over all documents, while its size depends on the capacity and not on the corpus.
Pieces then look their place up by their rank among the pieces of their length (ranks.ranked: no task gets a whole length).

Scale: one scan tokenises and writes the pieces; the only shuffles are over rows without their tokens.

Defined cases: a null or empty text is one piece, the end token; a longer document than the capacity is cut into pieces of
the capacity and a last one; rows may repeat, each is packed; null ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm import scratch, words
from quire.llm.ranks import BUCKETS, ranked
from quire.llm.words import lean, offsets

CAPACITY = 4096
END = 1
MEMO = 400_000
BLOCK = 1 << 20
ROWS_A_BUCKET = 100_000


class Capacities:
    """A segment tree over remaining capacities; a leaf holds groups (first sequence, how many) of open sequences."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.some = bytearray(2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        if n <= 0:
            return
        self.groups[room].append((first, n))
        k = room + self.size
        while k and not self.some[k]:
            self.some[k] = 1
            k //= 2

    def take(self, room: int) -> tuple[int, int]:
        out = self.groups[room].pop()
        if not self.groups[room]:
            k = room + self.size
            self.some[k] = 0
            k //= 2
            while k and not (self.some[2 * k] or self.some[2 * k + 1]):
                self.some[k] = 0
                k //= 2
        return out

    def tightest(self, least: int) -> int | None:
        """The smallest capacity from `least` on that has an open sequence."""
        k = least + self.size
        if self.some[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, how many, first sequence, pieces to a sequence, offset of the first), and the number of sequences."""
    tree, rows, made = Capacities(capacity), [], 0
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, each = capacity, capacity // size
                first, n = made, -(-left // each)
                made += n
            else:
                (first, n), each = tree.take(room), room // size
            used = min(n, -(-left // each))
            tree.add(room, first + used, n - used)
            here = min(left, used * each)
            rows.append((size, rank, here, first, each, capacity - room))
            full = here // each
            tree.add(room - each * size, first, full)
            if full < used:
                tree.add(room - (here - full * each) * size, first + full, 1)
            rank += here
            left -= here
    return np.array(rows, np.int64).reshape(-1, 6), made


# kinds of bytes: 0 what is left to the library, 1 letters, 2 digits, 3 marks, 4 white space
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 4
_KIND[[ord("'"), *range(0x1C, 0x20)]] = 0
_CUT = np.array([a == 4 or b == 4 or (a > 0 and b > 0 and (a != b or a == 2)) for a in range(5) for b in range(5)])
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_MARKS = re.escape(bytes(np.flatnonzero(_KIND == 3).tolist()))
_WHOLE = re.compile(rb"%b+|[0-9]|[%b]+" % (_LETTER, _MARKS))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, and where units start and end: ranges that no pre-token reaches out of.

    Cuts are at white space, at digits, and between letters and marks, all of ASCII or (letters) of U+00C0 to U+00FF. None
    of these joins what stands before it in NFC. An apostrophe and all other characters stay with their neighbours. A capital
    before such a character stays one, as only its small letter may have a form with a mark (J and U+030C).
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = 1
    kind[lead + 1] = 1
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
    cut[off] = True
    at = np.flatnonzero(cut)
    inner = kind[at[:-1]] != 4
    upper = (data - np.uint8(65)) < 26
    upper[:-1] &= (data[1:] < 0x80) | (data[1:] == 0xC3)
    return data + (upper.view(np.uint8) << np.uint8(5)), at[:-1][inner], at[1:][inner]


class Encoder:
    """Ids of texts by the tokenizers library, for a vocabulary that drops white space and lowers case before it splits.

    Its merges never span pre-tokens, so ids of a text are those of its units in turn. A worker keeps the ids of units it has
    met, up to a bound; only others reach the library, once a block. Units of up to 15 bytes are found by these bytes and
    their number, side by side in two 64-bit values, in a table of open addresses; longer ones in a dictionary.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = memo
        ends = np.zeros(self.library.get_vocab_size(), bool)
        for s, k in self.library.get_vocab().items():
            ends[k] = s.endswith("</w>")
        self.ends = ends
        self.special = [str(t).encode() for t in (x.content for x in self.library.get_added_tokens_decoder().values())]
        bits = (2 * memo).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros((memo + 1, 2), np.uint64)
        self.long: dict[bytes, int] = {}
        # of each unit: where its ids begin in pool, and how many they are; behind those kept, the present block's others
        self.begin, self.size, self.pool = np.zeros(memo, np.int64), np.zeros(memo, np.int64), np.zeros(4 * memo, np.uint32)
        self.n = 0

    def home(self, key: np.ndarray) -> np.ndarray:
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) + key[:, 1] * np.uint64(0xD1342543DE82EF95)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The numbers of the units with these keys, or -1."""
        out = np.full(len(key), -1, np.int64)
        live, at = np.arange(len(key)), self.home(key)
        while len(live):
            e = self.slots[at]
            there = e >= 0
            hit = there & (self.keys[e] == key).all(axis=1)
            out[live[hit]] = e[hit]
            on = there & ~hit
            live, at, key = live[on], (at[on] + 1) & (len(self.slots) - 1), key[on]
        return out

    def enter(self, number: np.ndarray, key: np.ndarray) -> None:
        self.keys[number] = key
        at = self.home(key)
        while len(number):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            on = self.slots[at] != number
            number, at = number[on], (at[on] + 1) & (len(self.slots) - 1)

    def ask(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units by the library, and how many each has."""
        whole = [_WHOLE.fullmatch(w) is not None for w in found]
        ids: list[np.ndarray] = []
        size = np.zeros(len(found), np.int64)
        order = [k for k, x in enumerate(whole) if x]
        for a in range(0, len(order), 4000):  # each of these is one pre-token
            some = order[a : a + 4000]
            x = np.array(self.library.encode(b" ".join([found[k] for k in some]).decode(), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[x])
            assert len(last) == len(some)
            size[some] = np.diff(last, prepend=-1)
            ids.append(x)
        other = [k for k, x in enumerate(whole) if not x]
        for k, e in zip(other, self.library.encode_batch_fast([found[k].decode() for k in other], add_special_tokens=False)):
            size[k] = len(e.ids)
            ids.append(np.array(e.ids, np.uint32))
        order += other
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        begin = np.zeros(len(found), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return flat[spread(begin, size)], size

    def learn(self, met: list[bytes], key: np.ndarray) -> np.ndarray:
        """The numbers of units that find has not found; key as for find."""
        fresh: dict[bytes, int] = {}
        out, first, n = [], [], self.n
        for k, w in enumerate(met):
            e = self.long.get(w)
            if e is None:
                e = fresh.get(w)
                if e is None:
                    e = fresh[w] = n + len(fresh)
                    first.append(k)
            out.append(e)
        if fresh:
            ids, size = self.ask(list(fresh))
            used = int(self.begin[n - 1] + self.size[n - 1]) if n else 0
            self.begin, self.size = roomy(self.begin, n + len(size)), roomy(self.size, n + len(size))
            self.pool = roomy(self.pool, used + len(ids))
            self.pool[used : used + len(ids)] = ids
            self.size[n : n + len(size)] = size
            self.begin[n : n + len(size)] = used + np.cumsum(size) - size
            kept = list(fresh)[: max(self.memo - n, 0)]
            self.long.update((w, n + k) for k, w in enumerate(kept) if len(w) > 15)
            short = np.flatnonzero([len(w) <= 15 for w in kept])
            self.enter(n + short, key[np.array(first, np.int64)[short]])
            self.n = n + len(kept)
        return np.array(out, np.int64)

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, or parts of them that end with a word, and how many each has."""
        data, start, end = units(data, off)
        n = end - start
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        key = np.empty((len(start), 2), np.uint64)
        key[:, 0] = eight[start] & _LOW[np.minimum(n, 8)]
        key[:, 1] = eight[start + 8] & _LOW[np.clip(n - 8, 0, 7)] | np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
        unit = np.full(len(start), -1, np.int64)
        short = n <= 15
        unit[short] = self.find(key[short])
        left = np.flatnonzero(unit < 0)
        if len(left):
            raw = data.tobytes()
            unit[left] = self.learn([raw[a:b] for a, b in zip(start[left].tolist(), end[left].tolist())], key[left])
        size = self.size[unit]
        c = np.concatenate([[0], np.cumsum(size)])
        return self.pool[spread(self.begin[unit], size)], np.diff(c[np.searchsorted(start, off)])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        data, off = offsets(texts)
        raw, whole = data.tobytes(), {}
        if any(x in raw for x in self.special):
            data = data.copy()
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                if any(raw.find(x, a, b) >= 0 for x in self.special):
                    whole[k] = np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
                    data[a:b] = 0x20
            raw = data.tobytes()
        ids, count, at = [np.zeros(0, np.uint32)], np.zeros(len(off) - 1, np.int64), 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            edge = int(off[np.searchsorted(off, end)])
            if space := _WHITE.search(raw, end, edge):
                edge = space.start()
            a, b = np.searchsorted(off, at, "right") - 1, np.searchsorted(off, edge)
            x, n = self.block(data[at:edge], np.clip(off[a : b + 1], at, edge) - at)
            ids.append(x)
            count[a:b] += n
            at = edge
        if not whole:
            return np.concatenate(ids), count
        each = np.split(np.concatenate(ids), np.cumsum(count)[:-1])
        for k, x in whole.items():
            each[k] = x
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, count = self.column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(count)[:-1]) if len(count) else []


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, and so on, size of them, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n values and as many again."""
    if n <= len(x):
        return x
    out = np.zeros(2 * n, x.dtype)
    out[: len(x)] = x
    return out


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The id, piece, start, length, and ids (unsigned 32-bit little-endian) of every piece of every document."""
    slim = docs.select(F.col(id_col).alias("given"), F.col(text).alias("measured"))

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for a, b in words.pieces(batch, "measured"):
                part = batch.slice(a, b - a)
                ids, count = own.column(part.column("measured"))
                total = count + 1
                last = np.zeros(int(total.sum()), bool)
                last[np.cumsum(total) - 1] = True
                flat = np.full(len(last), end, "<u4")
                flat[~last] = ids
                many = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(total[row] - start, capacity)
                where = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(where), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column("given").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), made], names=["given", "piece", "start", "length", "ids"])

    schema = StructType([slim.schema["given"], *StructType.fromDDL("piece int, start long, length long, ids binary").fields])
    return slim.mapInArrow(lean(run), schema).withColumnRenamed("given", id_col)


def place(table: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """table, which must be written data, with sequence_id and offset of each row."""
    spark = table.sparkSession
    # at most `capacity` rows come to the driver
    counts = {int(r[0]): int(r[1]) for r in table.groupBy(length).count().collect()}
    rows, _ = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shift = 48
    held = spark.sparkContext.broadcast((rows[:, 0] << shift | rows[:, 1], rows))
    by_rank = ranked(table.withColumnRenamed(length, "_length"), ["_length"], order, "_rank", max(BUCKETS, max(counts.values(), default=0) // ROWS_A_BUCKET))

    def run(batches):
        keys, rows = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("_length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            r = rows[np.searchsorted(keys, size << shift | rank, "right") - 1]
            k = rank - r[:, 1]
            cols = {n: batch.column(n) for n in batch.schema.names if n != "_rank"}
            cols |= {"sequence_id": pa.array(r[:, 3] + k // r[:, 4]), "offset": pa.array(r[:, 5] + k % r[:, 4] * size)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = StructType([f for f in by_rank.schema.fields if f.name != "_rank"] + StructType.fromDDL("sequence_id long, offset long").fields)
    return by_rank.mapInArrow(run, schema).withColumnRenamed("_length", length)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, digest: bool = False) -> DataFrame:
    """Each piece with its place; with digest, ids_crc32 in place of the ids themselves (taken from the written ids)."""
    made = scratch.write(pieces(docs, vocabulary, id_col, text, capacity, end), "pieces")
    # equal places in the order are equal rows or copies of them, whatever the order among these
    if digest:
        made = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
        return place(made, [id_col, "piece", "start", "ids_crc32"], capacity=capacity)
    return place(made, [id_col, "piece", "start"], capacity=capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its tokens: the pieces' ids in the order of their offsets; a sequence holds at most `capacity` ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"))
