"""Token counts at every prefix of a text, for a byte-level BPE vocabulary.

BPE tokens of a prefix follow from shorter prefixes: the last token t of p[:i] is the one token ending at i for which the
last token of p[:i - len(t)] and t form a valid pair (merging their bytes alone gives these two tokens again); the count is
then one more than the count at i - len(t). So one pass over the bytes of a pre-token gives the exact count at each of its
prefixes. A text's store is one signed byte per byte: the change of the count there. Its sums answer how many tokens a
prefix has and where a budget ends, without encoding again.

Pre-tokens are few against their occurrences, so a worker keeps the steps of those it has met (a bounded memo; beyond the
bound they are computed again, results are the same).

Defined cases: a null text counts as empty and has 0 tokens; the special string inside a text is one token, as by the
library's default; ids may be null or repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-token pattern of the public byte-level vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = regex.compile(r"\s+")
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
LIMIT = 1024
MEMO = 1_000_000


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class Memo(dict):
    """What has no room in it is found in late, which holds one batch; a word with a closing mark, by the word."""

    late: dict[str, bytes]

    def __missing__(self, key: str) -> bytes:
        made = self.late.get(key)
        if made is None:  # such a mark is a pre-token and a token of its own
            made = self[key[:-1]] + b"\x01"
        return made


class Steps:
    """The prefix store of texts, from a vocabulary file."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        ids = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.token = {raw(s): k for s, k in ids.items() if s not in self.special}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = ids[a], ids[b]
            self.rank[pair] = rank
            self.halves.setdefault(ids[a + b], pair)
        self.when = {t: self.rank[p] for t, p in self.halves.items()}
        self.tail: dict[bytes, int] = {}  # the longest token with these last three bytes
        for t in self.token:
            self.tail[t[-3:]] = max(self.tail.get(t[-3:], 0), len(t))
        self.valid: dict[int, bool] = {}
        self.spaced, self.plain = Memo(), Memo()
        self.memo = memo
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.odd = regex.compile(r"\s\s|[^\S \n]|^\s|\s$")

    def pair(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side as they are.

        Undo merges at the seam, latest first. What then meets there must not merge before the merge undone last on either
        side was made; with nothing left to undo, the pair holds.
        """
        x, y = a, b
        left = right = len(self.rank) + 1  # when x is merged away inside a, y inside b
        ok = True
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < left and r <= right:  # of equal merges the leftmost is made first
                ok = False
                break
            wx, wy = self.when.get(x, -1), self.when.get(y, -1)
            if wx < 0 and wy < 0:
                break
            if wx > wy:
                x, left = self.halves[x][1], wx
            else:
                y, right = self.halves[y][0], wy
        if len(self.valid) < 4_000_000:
            self.valid[a << 20 | b] = ok
        return ok

    def counts(self, p: bytes, last: list[int], count: list[int]) -> None:
        """Extends last and count, which hold the prefixes of p so far, to all prefixes of p."""
        token, valid, tail = self.token.get, self.valid.get, self.tail.get
        for i in range(len(count), len(p) + 1):
            # tokens of one or two bytes have themselves as tail
            most = max(tail(p[i - 3 : i], 0), 2) if i > 2 else i
            for n in range(most if most < i else i, 0, -1):
                t = token(p[i - n : i])
                if t is not None:
                    if n < i:
                        before = last[i - n]
                        ok = valid(before << 20 | t)
                        if not (self.pair(before, t) if ok is None else ok):
                            continue
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break

    def word(self, w: str) -> list[int]:
        """Counts at all prefixes of one pre-token, the empty one first."""
        if w in CONTRACTIONS and len(w) == 3:  # a part of it is no contraction: the quote stands alone
            end = [0]
            self.counts(w.encode(), [0], end)
            return [0, 1, 2, end[3]]
        last, count = [0], [0]
        self.counts(w.encode(), last, count)
        return count

    def segment(self, s: str) -> bytes:
        """Steps of a text without special strings, in general: a run of white space ends differently before a word."""
        pre, cum, base, k = PATTERN.findall(s), [0], 0, 0
        while k < len(pre):
            w = pre[k]
            if SPACES.fullmatch(w) and k + 1 < len(pre) and SPACES.fullmatch(pre[k + 1][0]):
                run = w + pre[k + 1][0]
                cum += [base + c for c in self.word(run)[1:]]
                base += self.word(w)[-1]
                after = self.word(pre[k + 1])
                cum += [base + c for c in after[1 + len(pre[k + 1][0].encode()) :]]
                base += after[-1]
                k += 2
            else:
                c = self.word(w)
                cum += [base + x for x in c[1:]]
                base += c[-1]
                k += 1
        return np.diff(np.array(cum, np.int64)).astype(np.int8).tobytes()

    def general(self, s: str) -> bytes:
        """Steps of any text: special strings are one token each, and end the segment before them."""
        out, at = [], 0
        for m in self.split.finditer(s) if self.split else ():
            partial = self.segment(s[at : m.end()])  # a prefix that ends inside the special string holds ordinary text
            whole = self.segment(s[at : m.start()])
            now = np.frombuffer(partial[:-1], np.int8)
            end = sum(np.frombuffer(whole, np.int8).tolist()) + 1 - int(now.astype(np.int64).sum())
            out += [partial[:-1], np.array([end], np.int8).tobytes()]
            at = m.end()
        return b"".join([*out, self.segment(s[at:])])

    def learn(self, chunks: set[str], lead: str, memo: Memo) -> None:
        """Puts the steps of chunks that the memo lacks where it finds them; sorted, so that neighbours share the work on a
        common prefix."""
        made = memo.late = {}
        last, count, before = [0], [0], b""
        ends = {c for c in chunks if c[-1] in ".," and c[-2:-1].isalpha()}
        for c in sorted((chunks - ends) | {c[:-1] for c in ends if c[:-1] not in memo}):
            w = lead + c
            rest = ()
            if not c.isalpha():
                w, *rest = PATTERN.findall(w)
            if w in CONTRACTIONS:
                cum = self.word(w)
            else:
                p = w.encode()
                n, top = 0, min(len(p), len(before))
                while n < top and p[n] == before[n]:
                    n += 1
                del last[n + 1 :], count[n + 1 :]
                self.counts(p, last, count)
                before, cum = p, count
            for w in rest:
                base = cum[-1]
                cum = cum + [base + x for x in self.word(w)[1:]]
            made[c] = array("b", map(sub, cum[1:], cum)).tobytes()
        if len(memo) + len(made) <= self.memo:
            memo.update(made)

    def steps(self, texts: list[str]) -> list[bytes]:
        """The store of each text."""
        split: list = []
        first: set[str] = set()
        rest: set[str] = set()
        for s in texts:
            if not s or self.odd.search(s) or self.split and self.split.search(s):
                split.append(self.general(s) if s else b"")
                continue
            lines = [x.split(" ") for x in s.split("\n")]
            for x in lines:
                first.add(x[0])
                rest.update(x[1:])
            split.append(lines)
        for memo, chunks, lead in ((self.plain, first, ""), (self.spaced, rest, " ")):
            self.learn({c for c in chunks if c not in memo}, lead, memo)
        plain, spaced = self.plain, self.spaced.__getitem__
        return [x if isinstance(x, bytes) else b"\x01".join([plain[y[0]] + b"".join(map(spaced, y[1:])) for y in x]) for x in split]


_HELD: dict[tuple, Steps] = {}


def stepper(path: str, memo: int = MEMO) -> Steps:
    """One per worker."""
    if (path, memo) not in _HELD:
        _HELD[path, memo] = Steps(path, memo)
    return _HELD[path, memo]


def tokens_at(store: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of n_bytes."""
    return int(np.frombuffer(store, np.int8)[:n_bytes].sum(dtype=np.int64))


def cut(store: bytes, text: str, budget: int) -> int:
    """Bytes of the longest prefix, whole characters only, that has at most budget tokens."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(np.append((raw & 0xC0) != 0x80, True))
    at = np.concatenate([[0], np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64)])[ends]
    return int(ends[np.flatnonzero(at <= budget)[-1]])


def prefix_store(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", memo: int = MEMO) -> DataFrame:
    """The id, n_bytes, n_tokens and the store (a byte per byte) of each row."""
    slim = docs.select(F.col(id_col).alias("given"), F.col(text).alias("measured"))

    def run(batches):
        own = stepper(vocabulary, memo)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                made = own.steps([x or "" for x in part.column("measured").to_pylist()])
                total = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in made]
                yield pa.RecordBatch.from_arrays([part.column("given"), pa.array([len(x) for x in made], pa.int64()), pa.array(total, pa.int64()), pa.array(made, pa.binary())], names=["given", "n_bytes", "n_tokens", "steps"])

    kind = slim.schema["given"].dataType.simpleString()
    return slim.mapInArrow(run, f"given {kind}, n_bytes long, n_tokens long, steps binary").withColumnRenamed("given", id_col)


def within(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_tokens, and the bytes, tokens and text of the longest prefix within a budget of tokens."""
    slim = docs.select(F.col(id_col).alias("given"), F.col(text).alias("measured"))

    def run(batches):
        own = stepper(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [x or "" for x in part.column("measured").to_pylist()]
                made = own.steps(texts)
                ends = [cut(m, x, budget) for m, x in zip(made, texts)]
                cols = [[tokens_at(m, len(m)) for m in made], ends, [tokens_at(m, e) for m, e in zip(made, ends)]]
                yield pa.RecordBatch.from_arrays([part.column("given"), *[pa.array(c, pa.int64()) for c in cols], pa.array([x.encode()[:e].decode() for x, e in zip(texts, ends)], pa.string())], names=["given", "n_tokens", "cut_bytes", "cut_tokens", "cut_text"])

    kind = slim.schema["given"].dataType.simpleString()
    return slim.mapInArrow(run, f"given {kind}, n_tokens long, cut_bytes long, cut_tokens long, cut_text string").withColumnRenamed("given", id_col)
