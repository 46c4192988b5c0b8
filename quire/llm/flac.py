"""Media columns: FLAC streams of 8-bit mono samples, written and read many frames at a time.

Writing: frames of 1024 samples; each takes the cheapest of constant, verbatim, fixed predictors and a quantised linear
predictor of order 8, with Rice-coded residuals in partitions of 256; a seek table names every frame's first sample and
byte offset; checksums as the format has them (CRC-8 of headers, CRC-16 of frames, MD5 of the samples).

Reading: all frames of a batch are decoded side by side, a sample of each per step, so the sequential parts of the format
(unary codes, predictors) run over arrays. Frames are found by the seek table, else one after the other. Any order,
partition order, escape code and block size of the subset with one channel of 8 bits is read. Checksums are verified.

A payload byte b is the sample b - 128 (unsigned 8-bit PCM). Scale: rows are independent, nothing is shuffled.

Defined cases: a null or empty text is a payload of 64 zero bytes; ids may be null or repeat; equal texts have equal
streams, wherever they stand (integer arithmetic, and elementwise floats for the predictor); a damaged stream raises
ValueError naming the check that failed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.words import offsets

BLOCK = 1024
PART = 256
ORDER = 8
PRECISION = 12
SHIFT = 10
RATE = 8000
ENCODE, DECODE = 1 << 20, 4 << 20
PAD = 64
# Coefficients of the format's fixed predictors, of the sample before first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_row(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, c << 1 ^ poly, c << 1) & ((1 << bits) - 1)
    return c


_CRC8, _CRC16 = _crc_row(0x07, 8), _crc_row(0x8005, 16)
_FAR = [_CRC16.astype(np.uint16)[None, :]]


def _far(n: int) -> np.ndarray:
    """Row d: what a byte d places before the last adds to the CRC-16."""
    if len(_FAR[0]) < n:
        rows = [_FAR[0][0].astype(np.uint32)]
        for _ in range(max(n, BLOCK + 64) - 1):
            c = rows[-1]
            rows.append((c << 8 & 0xFFFF) ^ _CRC16[c >> 8])
        _FAR[0] = np.array(rows, np.uint16)
    return _FAR[0]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of the byte ranges, which do not overlap and rise."""
    n = end - start
    table = _far(int(n.max()))
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    far = np.repeat(n, n) - 1 - at
    return np.bitwise_xor.reduceat(table[far, buf[np.repeat(start, n) + at]], first)


def _number(n: int) -> bytes:
    """A frame's number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << (5 * m + 6 if m < 6 else 36))
    lead = 0xFF << (7 - more) & 0xFF | (n >> 6 * more if more < 6 else 0)
    return bytes([lead, *[0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1)]])


@functools.lru_cache(100_000)
def _header(number: int, n: int) -> bytes:
    h = bytes([0xFF, 0xF8, (0xA0 if n == BLOCK else 0x70) | 0x04, 0x02]) + _number(number)
    if n != BLOCK:
        h += struct.pack(">H", n - 1)
    return h + bytes([crc8(h)])


def _levinson(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each row of samples; zero where the signal is zero."""
    lanes = len(x)
    r = np.empty((ORDER + 1, lanes))
    f = x.astype(np.float32)  # exact: sums of at most 1024 products below 2^14
    for k in range(ORDER + 1):
        r[k] = np.einsum("ij,ij->i", f[:, : x.shape[1] - k], f[:, k:])
    a = np.zeros((ORDER, lanes))
    err = r[0] * (1 + 1e-9) + 1
    for i in range(ORDER):
        acc = r[i + 1].copy()
        for j in range(i):
            acc -= a[j] * r[i - j]
        k = acc / err
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a = new
        err = np.maximum(err * (1 - k * k), 1e-3)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int32)


def _parameters(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameters by row and partition, and about the bits of each row's residual. Rows shorter than a block have one partition."""
    total = np.add.reduceat(u, np.arange(0, BLOCK, PART), axis=1).astype(np.int64)
    whole = n == BLOCK
    total[~whole] = total[~whole].sum(1, keepdims=True)
    size = np.where(whole, PART, n)[:, None]
    k = np.clip(np.frexp(np.maximum(total / size * 0.72, 0.5))[1] - 1, 0, 14)
    bits = size * (k + 1) + np.maximum((total >> k) - size // 2 * (k > 0), 0)
    return k, np.where(whole, bits.sum(1), bits[:, 0])


def _residual(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    """Zigzag residuals of a predictor: coef (order, rows or 1); the first samples, which it does not reach, as if after zeros."""
    guess = np.zeros(x.shape, np.int32)
    for j in range(len(coef)):
        guess[:, j + 1 :] += coef[j][:, None] * x[:, : x.shape[1] - j - 1]
    e = x - (guess >> shift if shift else guess)
    return e << 1 ^ e >> 31


def _put(out: np.ndarray, pos: np.ndarray, value: np.ndarray, width) -> None:
    """Adds fields of up to 16 bits at rising bit positions to the 32-bit words."""
    if not len(pos):
        return
    word = pos >> 5
    v = value << (63 - (pos & 31) - width)  # 63 bits, so that no sign bit is touched
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    at = word[first]
    out[at] += np.add.reduceat(v >> 31, first)
    out[at + 1] += np.add.reduceat((v & 0x7FFFFFFF) << 1, first)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stream of each payload; payloads are not empty."""
    size = np.array([len(p) for p in payloads])
    frames = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(size[doc] - number * BLOCK, BLOCK)
    flat = np.frombuffer(b"".join(p + bytes(-len(p) % BLOCK) for p in payloads), np.uint8)
    x = (flat.astype(np.int32) - 128).reshape(-1, BLOCK)
    inside = np.arange(BLOCK) < n[:, None]
    x[~inside] = 0
    lanes = len(x)
    # the choice of the predictor
    lpc = _levinson(x, n)
    tries = [(o, np.array(c, np.int32)[:, None], 0) for o, c in enumerate(FIXED[:3])] + [(ORDER, lpc, SHIFT)]
    least = 8 * n
    kind = np.full(lanes, 1)
    order = np.zeros(lanes, np.int64)
    param = np.zeros((lanes, BLOCK // PART), np.int64)
    codes = np.zeros(x.shape, np.int32)
    for k, (o, coef, shift) in enumerate(tries):
        u = _residual(x, coef, shift)
        u[:, :o] = 0
        u[~inside] = 0
        par, bits = _parameters(u, n)
        bits = bits + 8 * o + 6 + 4 * par.shape[1] + (9 + PRECISION * ORDER if shift else 0)
        better = (bits < least) & (n > 2 * ORDER)
        least = np.where(better, bits, least)
        kind[better] = 8 + o if not shift else 32 + ORDER - 1
        order[better] = o
        param[better] = par[better]
        codes[better] = u[better]
    constant = (x == x[:, :1]).sum(1) >= n
    constant &= ((x == x[:, :1]) | ~inside).all(1)
    kind[constant] = 0
    order[constant] = 0
    coded = kind >= 8
    # where each field stands: lengths first, then positions within the frame, in bits
    heads = [_header(a, b) for a, b in zip(number.tolist(), n.tolist())]
    head = np.array([len(h) for h in heads])
    parts = np.where(n == BLOCK, BLOCK // PART, 1)
    k = np.repeat(param, PART, 1).astype(np.int32)
    col = np.arange(BLOCK)
    sent = inside & (col >= order[:, None]) & coded[:, None]
    length = (codes >> k) + 1 + k
    length[~sent] = 0
    run = np.cumsum(length, 1)
    # an estimate may have been too low: plain samples are never larger than this
    swollen = coded & (run[:, -1] + 4 * parts + 8 * order + 6 + np.where(kind >= 32, 9 + PRECISION * ORDER, 0) > 8 * n)
    kind[swollen], order[swollen], coded[swollen] = 1, 0, False
    sent[swollen] = False
    fixed = 8 + np.where(kind == 0, 8, np.where(kind == 1, 8 * n, 8 * order + 6 + np.where(kind >= 32, 9 + PRECISION * ORDER, 0)))
    bits = fixed + np.where(coded, run[:, -1] + 4 * parts, 0)
    body = -(-bits // 8)
    frame = head + body + 2
    meta = 4 + 4 + 34 + 4 + 18 * frames
    stream = meta + np.bincount(doc, frame, len(size)).astype(np.int64)
    base = np.cumsum(stream) - stream
    before = np.cumsum(frame) - frame
    in_doc = before - before[np.cumsum(frames) - frames][doc]
    start = base[doc] + meta[doc] + in_doc
    out = np.zeros(int(stream.sum()) // 4 + 3, np.int64)  # words of 32 bits
    at = (start + head) * 8
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray | int]] = []  # position, value, width up to 16
    fields.append((at, kind << 1, 8))
    one = np.flatnonzero(kind == 0)
    fields.append((at[one] + 8, x[one, 0] & 255, 8))
    raw = np.flatnonzero(kind == 1)
    r, c = np.nonzero(inside[raw])
    fields.append((at[raw][r] + 8 + 8 * c, x[raw][r, c] & 255, 8))
    warm = np.arange(ORDER) < order[:, None]
    r, c = np.nonzero(warm)
    fields.append((at[r] + 8 + 8 * c, x[r, c] & 255, 8))
    lp = np.flatnonzero(kind >= 32)
    fields.append((at[lp] + 8 + 8 * ORDER, np.full(len(lp), (PRECISION - 1) << 5 | SHIFT), 9))
    for j in range(ORDER):
        fields.append((at[lp] + 8 + 8 * ORDER + 9 + PRECISION * j, lpc[j][lp] & ((1 << PRECISION) - 1), PRECISION))
    rc = np.flatnonzero(coded)
    res = at + fixed
    fields.append((res[rc] - 6, np.where(parts[rc] > 1, (BLOCK // PART).bit_length() - 1, 0), 6))
    for j in range(BLOCK // PART):
        rows = rc[parts[rc] > j]
        past = run[rows, j * PART - 1] if j else 0
        fields.append((res[rows] + 4 * j + past, param[rows, j], 4))
    which = np.where(parts > 1, 1, 0)[:, None] * (col // PART) + 1
    kk = k[sent]
    stop = (res[:, None] + run + 4 * which)[sent]
    fields.append((stop - kk - 1, 1 << kk | codes[sent] & ((1 << kk) - 1), kk + 1))
    for pos, value, width in fields:
        _put(out, pos, np.asarray(value).astype(np.int64), width)
    buf = out.astype(">u4").view(np.uint8)
    for s, h in zip(start.tolist(), heads):
        buf[s : s + len(h)] = np.frombuffer(h, np.uint8)
    end = start + frame
    crc = crc16(buf, start, end - 2)
    buf[end - 2], buf[end - 1] = crc >> 8, crc & 255
    points = np.zeros(len(doc), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points["sample"], points["offset"], points["n"] = number * BLOCK, in_doc, n
    table, whole = points.tobytes(), buf.tobytes()
    first = (np.cumsum(frames) - frames).tolist()
    made = []
    for d, p in enumerate(payloads):
        f, m = first[d], int(frames[d])
        sizes = frame[f : f + m]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        md5 = hashlib.md5((x[f : f + m].astype(np.int8).tobytes())[: len(p)]).digest()
        front = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + md5 + b"\x83" + (18 * m).to_bytes(3, "big") + table[18 * f : 18 * (f + m)]
        made.append(front + whole[int(base[d] + meta[d]) : int(base[d] + stream[d])])
    return made


@functools.lru_cache(100_000)
def _read_header(h: bytes) -> tuple[int, int, int, int]:
    """Length of the header, samples in the frame, the frame's or first sample's number, whether that is a sample's."""
    if h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should be")
    size, rate = h[2] >> 4, h[2] & 15
    if h[3] >> 4 or (h[3] >> 1 & 7) not in (0, 1):
        raise ValueError("not one channel of 8 bits")
    at, lead = 5, h[4]
    number = lead
    if lead >= 0x80:
        more = 8 - (lead ^ 0xFF).bit_length() - 1
        number = lead & ((1 << (6 - more)) - 1) if more < 6 else 0
        for _ in range(more):
            number = number << 6 | h[at] & 0x3F
            at += 1
    if size == 1:
        n = 192
    elif 2 <= size <= 5:
        n = 576 << (size - 2)
    elif size == 6:
        n, at = h[at] + 1, at + 1
    elif size == 7:
        n, at = (h[at] << 8 | h[at + 1]) + 1, at + 2
    elif size >= 8:
        n = 256 << (size - 8)
    else:
        raise ValueError("a reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(h[:at]) != h[at]:
        raise ValueError("CRC-8 of a frame header")
    return at + 1, n, number, h[1] & 1


def _frames(buf: np.ndarray, whole: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frame, time), block sizes, ends, and numbers (with: is it a sample's) of the frames that start there."""
    heads = [_read_header(whole[s : s + 16]) for s in start.tolist()]
    n = np.array([h[1] for h in heads])
    rank = np.argsort(-n, kind="stable")
    n = n[rank]
    lanes, steps = len(n), int(n[0])
    w = buf.astype(np.uint64)
    window = np.zeros(len(buf) - 8, np.uint64)
    for k in range(8):
        window |= w[k : len(buf) - 8 + k] << np.uint64(56 - 8 * k)
    del w

    def bits(pos: np.ndarray, width) -> np.ndarray:
        v = window[pos >> 3] << (pos & 7).astype(np.uint64)
        return ((v >> np.uint64(1)) >> (np.uint64(63) - np.asarray(width).astype(np.uint64))).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> np.maximum(width - 1, 0) & 1) << width) * (np.asarray(width) > 0)

    pos = (start[rank] + np.array([heads[r][0] for r in rank])) * 8
    kind = bits(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    pos += 8
    linear = kind >= 32
    order = np.where(linear, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (~linear & (kind > 1) & ~((kind >= 8) & (kind <= 12))).any():
        raise ValueError("a reserved subframe")
    constant, verbatim = kind == 0, kind == 1
    order[constant] = 1
    top = int(order.max())
    out = np.zeros((steps, lanes), np.int32)
    for j in range(top):
        at = np.flatnonzero(order > j)
        out[j, at] = signed(bits(pos[at], 8), 8)
        pos[at] += 8
    coef, shift = np.zeros((max(top, 1), lanes), np.int64), np.zeros(lanes, np.int64)
    at = np.flatnonzero(linear)
    if len(at):
        width = bits(pos[at], 4) + 1
        shift[at] = bits(pos[at] + 4, 5)
        pos[at] += 9
        for j in range(top):
            own = order[at] > j
            here = at[own]
            coef[j, here] = signed(bits(pos[here], width[own]), width[own])
            pos[here] += width[own]
    for o, c in enumerate(FIXED):
        for j, v in enumerate(c):
            if j < top:
                coef[j, kind == 8 + o] = v
    coef[0, constant] = 1
    small = bool((np.abs(coef).sum(0) < 1 << 22).all())
    coef = coef.astype(np.int32) if small else coef
    shift = shift.astype(coef.dtype)
    coded = np.flatnonzero(~constant & ~verbatim)
    wide = np.zeros(lanes, np.int64)  # bits of a Rice parameter
    part = np.full(lanes, steps + 1)
    if len(coded):
        method = bits(pos[coded], 2)
        if (method > 1).any():
            raise ValueError("a reserved residual")
        wide[coded] = 4 + method
        part[coded] = n[coded] >> bits(pos[coded] + 2, 4)
        pos[coded] += 6
    events = defaultdict(list)
    where, lane = [order[coded]], [coded]
    for p in np.unique(part[coded]).tolist():
        own = coded[part[coded] == p]
        for at in range(p, steps, p):
            some = own[n[own] > at]
            where.append(np.full(len(some), at))
            lane.append(some)
    where, lane = np.concatenate(where), np.concatenate(lane)
    by = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[by])) + 1
    for piece in np.split(by, cuts):
        if len(piece):
            events[int(where[piece[0]])] = lane[piece]
    k = np.zeros(lanes, np.int64)
    raw = np.where(verbatim, 8, np.where(constant, 0, -1))  # bits of plain values, -1 for Rice codes
    active = np.searchsorted(-n, -np.arange(steps), "left")
    some_raw = bool((raw >= 0).any())
    later = order > 0
    one = np.uint64(1)
    for t in range(steps):
        m = int(active[t])
        if t in events:
            e = events[t]
            k[e] = bits(pos[e], wide[e])
            pos[e] += wide[e]
            escape = e[k[e] == (1 << wide[e]) - 1]
            raw[e] = -1
            if len(escape):
                raw[escape] = bits(pos[escape], 5)
                pos[escape] += 5
                k[escape] = 0
                some_raw = True
            if some_raw:
                some_raw = bool((raw >= 0).any())
        p, kk = pos[:m], k[:m]
        v = window[p >> 3] << (p & 7).astype(np.uint64)
        zeros = 32 - np.frexp((v >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        long = np.flatnonzero(zeros == 32)
        if len(long):
            own = raw[:m] < 0
            if t < top:
                own &= order[:m] <= t
            long = long[own[long]]
            for z in long.tolist():
                q = int(p[z])
                while not whole[q >> 3] << (q & 7) & 255:
                    q += 8 - (q & 7)
                q += 8 - (whole[q >> 3] << (q & 7) & 255).bit_length()
                zeros[z] = q - int(p[z])
                v[z] = window[q >> 3] << np.uint64(q & 7)
        taken = zeros if not len(long) else np.where(np.isin(np.arange(m), long), 0, zeros)
        low = ((v << taken.astype(np.uint64) << one >> one) >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
        u = zeros << kk | low
        step = zeros + 1 + kk
        e = u >> 1 ^ -(u & 1)
        if some_raw:
            r = np.flatnonzero(raw[:m] >= 0)
            e[r] = signed(bits(p[r], raw[r]), raw[r])
            step[r] = raw[r]
        if top:
            lag = min(top, t)
            guess = coef[0, :m] * out[t - 1, :m] if lag else np.zeros(m, coef.dtype)
            for j in range(1, lag):
                guess += coef[j, :m] * out[t - 1 - j, :m]
            e += guess >> shift[:m]
        if t < top:
            done = later[:m] & (order[:m] > t)
            e = np.where(done, out[t, :m], e)
            step = np.where(done, 0, step)
        out[t, :m] = e
        pos[:m] += step
    end = (pos + 7 >> 3) + 2
    back = np.empty(lanes, np.int64)
    back[rank] = np.arange(lanes)
    end, n = end[back], n[back]
    by = np.argsort(start)
    want = crc16(buf, start[by], end[by] - 2)
    if (want != (buf[end[by] - 2].astype(np.int64) << 8 | buf[end[by] - 1])).any():
        raise ValueError("CRC-16 of a frame")
    number = np.array([(h[2], h[3]) for h in heads])
    return (out + 128).astype(np.uint8).T[back], n, end, number


def decode(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """Of each stream its blocks: first sample, byte offset of the frame in the stream, PCM (unsigned 8-bit)."""
    whole = b"".join(streams) + bytes(24)
    buf = np.frombuffer(whole, np.uint8)
    base, total, digest, todo, doc = 0, [], [], [], []
    bases, first, open_ended, block = [], [], [], []
    for d, s in enumerate(streams):
        if s[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, points = 4, 0, None
        while not last:
            last, what, size = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
            if what == 0:
                word = int.from_bytes(s[at + 14 : at + 22], "big")
                total.append(word & ((1 << 36) - 1))
                digest.append(s[at + 22 : at + 38])
                block.append(int.from_bytes(s[at + 6 : at + 8], "big"))
            elif what == 3:
                points = np.frombuffer(s, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]), size // 18, at + 4)
                points = points[points["sample"] != (1 << 64) - 1]
            at += 4 + size
        bases.append(base)
        first.append(at)
        if points is not None and len(points) and int(points["n"].astype(np.int64).sum()) == total[-1]:
            todo.append(points["offset"].astype(np.int64) + base + at)
            doc.append(np.full(len(points), d))
        elif total[-1]:
            open_ended.append(d)
        base += len(s)
    made: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]

    def keep(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, n, end, number = _frames(buf, whole, start)
        for k, d in enumerate(owner.tolist()):
            made[d].append((int(number[k, 0]) * (1 if number[k, 1] else block[d]), int(start[k]) - bases[d], x[k, : n[k]].tobytes()))
        return n, end

    if todo:
        keep(np.concatenate(doc), np.concatenate(todo))
    at = np.array([bases[d] + first[d] for d in open_ended], np.int64)
    left = np.array([total[d] for d in open_ended], np.int64)
    owner = np.array(open_ended, np.int64)
    while len(owner):
        n, at = keep(owner, at)
        left = left - n
        more = left > 0
        owner, at, left = owner[more], at[more], left[more]
    for d, blocks in enumerate(made):
        blocks.sort()
        pcm = np.frombuffer(b"".join(b[2] for b in blocks), np.uint8)
        if len(pcm) != total[d] or digest[d] != bytes(16) and hashlib.md5((pcm ^ 128).tobytes()).digest() != digest[d]:
            raise ValueError("MD5 of the samples")
    return made


def payload(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(PAD - len(text), -len(text) % PAD))


def _parts(sizes: np.ndarray, chunk: int):
    at = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + chunk, "right")) - 1)
        yield at, end
        at = end


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_bytes of the text, and its stream as column media."""
    slim = docs.select(F.col(id_col).alias("given"), F.col(text).alias("measured"))

    def run(batches):
        for batch in batches:
            data, off = offsets(batch.column("measured"))
            raw = data.tobytes()
            for a, b in _parts(np.diff(off), ENCODE):
                made = encode([payload(raw[x:y]) for x, y in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())])
                yield pa.RecordBatch.from_arrays([batch.column("given").slice(a, b - a), pa.array(np.diff(off[a : b + 1])), pa.array(made, pa.binary())], names=["given", "n_bytes", "media"])

    schema = StructType([slim.schema["given"], *StructType.fromDDL("n_bytes long, media binary").fields])
    return slim.mapInArrow(run, schema).withColumnRenamed("given", id_col)


def _over(media: DataFrame, columns: list[str], schema: str, rows):
    """A row per stream or block: the columns, then what rows(blocks, stream) gives for a stream."""
    slim = media.select(F.struct(*columns).alias("given"), "media")

    def run(batches):
        for batch in batches:
            streams = batch.column("media").to_pylist()
            for a, b in _parts(np.array([len(s) for s in streams], np.int64), DECODE):
                found = [rows(blocks, s) for blocks, s in zip(decode(streams[a:b]), streams[a:b])]
                own = [k for k, x in enumerate(found) for _ in x]
                flat = [x for y in found for x in y]
                cols = [pa.array([x[c] for x in flat], pa.type_for_alias(kinds[c])) for c in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([batch.column("given").slice(a, b - a).take(pa.array(own, pa.int64())), *cols], names=full.names)

    extra = StructType.fromDDL(schema)
    kinds = [{"bigint": "int64", "string": "string", "binary": "binary", "int": "int32"}[f.dataType.simpleString()] for f in extra]
    full = StructType([slim.schema["given"], *extra.fields])
    return slim.mapInArrow(run, full).select(*[F.col(f"given.`{c}`") for c in columns], *extra.names)


def blocks(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The PCM blocks of each stream: block, first_sample and byte_offset to seek by, n_samples, pcm."""
    return _over(media, [id_col], "block long, first_sample long, byte_offset long, n_samples long, pcm binary", lambda found, _: [(k, s, o, len(p), p) for k, (s, o, p) in enumerate(found)])


def summary(found: list[tuple[int, int, bytes]], stream: bytes) -> list[tuple]:
    """One row for a stream: payload and stream digests, and features of the samples read back."""
    pcm = b"".join(p for _, _, p in found)
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int((np.diff(np.signbit(x)) != 0).sum())
    feature = f"blocks={len(found)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"
    return [(len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), feature)]


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, n_bytes and the summary of each stream, from its blocks read back and verified."""
    return _over(media, [id_col, "n_bytes"], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", summary)
