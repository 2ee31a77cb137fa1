"""FLAC in numpy: mono 8-bit streams with 576-sample blocks, many frames in lockstep.

All frames of a group of streams are coded together: one numpy step handles one sample,
or one pair of bytes, of every frame. The decoder takes any mono stream of up to 16 bits
with constant, verbatim, fixed and LPC subframes, both Rice methods and any partition
order; frame headers (CRC-8) and frames (CRC-16) are verified, and so is the stream's
MD5. Decoded frames are PCM blocks with their sample offsets; a seek table gives the
byte offset of each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576
#: Frames coded together.
GROUP = 2048
LPC_ORDERS = (4,)
LPC_PRECISION = 10
SEEK_EVERY = 64

PARTITION_ORDERS = (0, 2)

# Fixed predictors: the residual of order n is the n-th difference.


def _crc_table(bits: int, poly: int, words: int) -> np.ndarray:
    """The remainders of all values of 8*words bits."""
    table = np.zeros(1 << (8 * words), np.uint32)
    v = np.arange(len(table), dtype=np.uint32) << max(0, bits - 8 * words)
    mask, top = (1 << bits) - 1, 1 << (bits - 1)
    for _ in range(8 * words):
        v = np.where(v & top, (v << 1) ^ poly, v << 1) & mask
    table[:] = v
    return table


_CRC8 = _crc_table(8, 0x07, 1)
_CRC16 = _crc_table(16, 0x8005, 2)


def crc8(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-8 of the first lengths bytes of each row, rows in lockstep."""
    crc = np.zeros(len(rows), np.uint32)
    for i in range(int(lengths.max(initial=0))):
        crc = np.where(i < lengths, _CRC8[crc ^ rows[:, i]], crc)
    return crc


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of byte ranges: right-aligned, since leading zeros don't change it, and
    two bytes a step."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    width = int((ends - starts).max())
    width += width % 2
    at = ends[:, None] - width + np.arange(width)
    rows = np.where(at >= starts[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint32)
    words = np.ascontiguousarray(((rows[:, 0::2] << 8) | rows[:, 1::2]).T)
    crc = np.zeros(len(starts), np.uint32)
    for w in words:
        crc = _CRC16[crc ^ w]
    return crc


# ---- bits ---------------------------------------------------------------------------


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write values of some width at bit positions, most significant bit first."""
    width = np.broadcast_to(width, np.shape(at))
    for b in range(int(width.max(initial=0))):
        use = b < width
        bits[at[use] + b] = (value[use] >> (width[use] - 1 - b)) & 1


#: Zeros before the first one of a 16-bit value; 16 if there is none.
_ZEROS = np.full(1 << 16, 16, np.int64)
for _z in range(16):
    _ZEROS[1 << (15 - _z) : 1 << (16 - _z)] = _z


class _Bits:
    """Random access to a byte buffer's bits: fields of up to 32 bits and unary codes."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        n = len(buf) + 8
        self.words = np.zeros(n, np.uint64)
        rows = self.words.view(np.uint8).reshape(n, 8)  # little-endian: the last byte leads
        for k in range(8):
            rows[:, 7 - k] = padded[k : k + n]
        self.n_bits = 8 * len(buf)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each position, at the top of a word."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def field(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.asarray(width).astype(np.uint64)
        # A shift by 64 isn't defined: width 0 is shifted in two steps.
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def zeros(self, at: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        """How many zeros come before the next one."""
        n = _ZEROS[(self.window(at) if word is None else word) >> np.uint64(48)]
        more = np.flatnonzero(n == 16)
        while len(more):
            if (at[more] + n[more] >= self.n_bits).any():
                raise ValueError("a unary code runs over the end of the data")
            step = _ZEROS[self.window(at[more] + n[more]) >> np.uint64(48)]
            n[more] += step
            more = more[step == 16]
        return n


def _signed(v: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width, np.int64) - 1)
    return np.where(v >= half, v - 2 * half, v)


# ---- encoding -----------------------------------------------------------------------


def _utf8_number(k: int) -> bytes:
    """A frame number as FLAC writes it: UTF-8's scheme, up to 36 bits."""
    if k < 0x80:
        return bytes([k])
    n = 2
    while k >> (5 * n + 1):
        n += 1
    out = [0x80 | (k >> (6 * i)) & 0x3F for i in range(n - 1)][::-1]
    return bytes([(0xFF << (8 - n)) & 0xFF | k >> (6 * (n - 1)), *out])


def _header(k: int) -> bytes:
    """A frame header: fixed block size 576, rate from the stream info, mono, 8 bits."""
    head = b"\xff\xf8\x20\x02" + _utf8_number(k)
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of all rows by a batched Levinson recursion: coefs, shifts."""
    w = x * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(w[:, : w.shape[1] - k] * w[:, k:]).sum(axis=1) for k in range(order + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), order))
    err = r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / np.maximum(err, 1e-9)
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(LPC_PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int64)
    limit = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _rice(u: np.ndarray, order: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A good Rice parameter of each partition, and the bits of the residual coded so.

    u: zigzag residuals with the warm-up samples of a row at zero. The parameter next
    to the logarithm of the mean is compared with its neighbours.
    """
    v = u.reshape(len(u), parts, u.shape[1] // parts)
    count = np.full((len(u), parts), v.shape[2])
    count[:, 0] -= order
    mean = v.sum(axis=2) / np.maximum(count, 1)
    middle = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 1, 11).astype(np.int32)
    best = cost = None
    for k in (middle - 1, middle, middle + 1):
        c = (v >> k[:, :, None]).sum(axis=2) + count * (1 + k)
        if best is None:
            best, cost = k, c
        else:
            better = c < cost
            best, cost = np.where(better, k, best), np.where(better, c, cost)
    return best.astype(np.int64), cost.sum(axis=1) + 6 + 4 * parts


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of 576 8-bit samples each, coded together.

    Of the constant, verbatim, fixed (orders 0 to 4) and LPC forms each frame gets the
    shortest.
    """
    x = samples.astype(np.int32)
    n, m = x.shape
    best = np.full(n, 8 + 8 * m)  # bits, and what the subframe is to hold
    kind = np.full(n, 1)  # the subframe type code: 1 verbatim
    resid = np.zeros((n, m), np.int32)
    order_of, porder = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rice = np.zeros((n, 1 << max(PARTITION_ORDERS)), np.int64)
    coefs, shifts = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)

    def offer(r, order, code, extra, coef=None, shift=None):
        u = (r << 1) ^ (r >> 31)
        for i in range(int(order.max(initial=0))):
            u[i < order, i] = 0
        for p in PARTITION_ORDERS:
            k, bits = _rice(u, order, 1 << p)
            bits = bits + 8 + 8 * order + extra
            use = bits < best
            best[use], kind[use], order_of[use], porder[use] = bits[use], code[use], order[use], p
            resid[use] = u[use]
            rice[use, : 1 << p] = k[use]
            if coef is not None:
                coefs[use, : coef.shape[1]], shifts[use] = coef[use], shift[use]

    # The fixed predictor with the smallest residual.
    r, fixed, least, order = x, x, np.abs(x).sum(axis=1), np.zeros(n, np.int64)
    for o in range(1, 5):
        r = np.diff(r, axis=1, prepend=0)
        size = np.abs(r[:, o:]).sum(axis=1)
        use = size < least
        fixed = np.where(use[:, None], r, fixed)
        least, order = np.where(use, size, least), np.where(use, o, order)
    offer(fixed, order, 8 + order, 0)
    for o in LPC_ORDERS:
        a, shift = _lpc(x.astype(np.float32), o)
        pred = np.zeros_like(x)
        for k in range(o):
            pred[:, k + 1 :] += a[:, k : k + 1].astype(np.int32) * x[:, : m - k - 1]
        offer(x - (pred >> shift[:, None].astype(np.int32)), np.full(n, o), np.full(n, 31 + o), 9 + o * LPC_PRECISION, a, shift)
    flat = (x == x[:, :1]).all(axis=1)
    best[flat], kind[flat], order_of[flat] = 16, 0, 0

    heads = [_header(int(k)) for k in numbers]
    head_len = np.array([len(h) for h in heads], np.int64)
    total = head_len + (best + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(starts[-1]) * 8, np.uint8)
    codes = np.zeros(int(starts[-1]) + 2, np.uint8)
    begin = (starts[:-1] + head_len) * 8
    _put(out, begin, kind << 1, 8)
    at = begin + 8
    warm = np.where(kind == 0, 1, np.where(kind == 1, m, order_of))
    rows = np.repeat(np.arange(n), warm)
    col = np.arange(len(rows)) - np.repeat(np.cumsum(warm) - warm, warm)
    _put(out, at[rows] + 8 * col, x[rows, col] & 0xFF, 8)
    at = at + 8 * warm
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        _put(out, at[lpc], np.full(len(lpc), LPC_PRECISION - 1), 4)
        _put(out, at[lpc] + 4, shifts[lpc], 5)
        o = order_of[lpc]
        rows = np.repeat(lpc, o)
        col = np.arange(len(rows)) - np.repeat(np.cumsum(o) - o, o)
        _put(out, at[rows] + 9 + LPC_PRECISION * col, coefs[rows, col] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        at[lpc] += 9 + LPC_PRECISION * o
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        _put(out, at[coded] + 2, porder[coded], 4)  # method 0: 4-bit parameters
        at = at + 6
        size = m >> porder[coded]
        # Bits of every sample; a partition's parameter is written before its first.
        sample = np.arange(m)
        part = sample[None, :] // size[:, None]
        k = np.take_along_axis(rice[coded], part, 1)
        u = resid[coded].astype(np.int64)
        high = u >> k
        length = high + 1 + k
        length[sample[None, :] < order_of[coded][:, None]] = 0
        lead = np.where(sample[None, :] % size[:, None] == 0, 4, 0)
        spot = at[coded][:, None] + np.cumsum(length + lead, axis=1) - length
        heads_at = lead > 0
        _put(out, (spot - 4)[heads_at], k[heads_at], 4)
        live = length > 0
        # Stop bit and low bits make one field of at most 13 bits, so of three bytes.
        # Fields don't overlap: summing their bytes sets their bits.
        stop, k = (spot + high)[live], k[live]
        field = ((1 << k) | (u[live] & ((1 << k) - 1))) << (23 - (stop & 7) - k)
        byte = stop >> 3
        for b in range(3):
            codes += np.bincount(byte + b, (field >> (16 - 8 * b)) & 0xFF, len(codes)).astype(np.uint8)
    body = np.packbits(out) | codes[: int(starts[-1])]
    for i, h in enumerate(heads):
        body[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(body, starts[:-1], starts[1:] - 2)
    body[starts[1:] - 2], body[starts[1:] - 1] = crc >> 8, crc & 0xFF
    return [body[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _metadata(n_samples: int, frames: list[bytes], pcm: bytes) -> bytes:
    """fLaC, STREAMINFO with the MD5 of the samples, and a seek table."""
    sizes = [len(f) for f in frames]
    info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3)
    info += ((8000 << 44) | (0 << 41) | (7 << 36) | n_samples).to_bytes(8) + hashlib.md5(pcm).digest()
    points, byte = [], 0
    for i, s in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points.append((i * BLOCK).to_bytes(8) + byte.to_bytes(8) + BLOCK.to_bytes(2))
        byte += s
    seek = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its length must be a positive multiple of 576."""
    counts = [len(p) // BLOCK for p in payloads]
    every = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    samples = (every ^ 0x80).view(np.int8)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for at in range(0, len(samples), GROUP):
        frames += encode_frames(samples[at : at + GROUP], numbers[at : at + GROUP])
    out, first = [], 0
    for c in counts:
        own = frames[first : first + c]
        out.append(_metadata(c * BLOCK, own, samples[first : first + c].tobytes()) + b"".join(own))
        first += c
    return out


# ---- decoding -----------------------------------------------------------------------


@dataclass
class Info:
    """What a stream's metadata says, and where its frames begin."""

    block: int
    bits: int
    rate: int
    n_samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    frames_at: int


def read_info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the metadata is cut")
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18])
            if (v >> 41) & 7:
                raise ValueError("only mono streams are read")
            info = Info(int.from_bytes(body[2:4]), ((v >> 36) & 31) + 1, v >> 44, v & ((1 << 36) - 1), body[18:34], [], 0)
        elif kind == 3:
            seek = [(int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16]), int.from_bytes(body[i + 16 : i + 18])) for i in range(0, n, 18)]
        at += 4 + n
    if info is None:
        raise ValueError("no stream info")
    info.seek, info.frames_at = seek, at
    return info


_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16}


def _parse_headers(buf: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(valid, header bytes, block sizes, frame numbers) of possible headers."""
    rows = buf[np.minimum(at[:, None] + np.arange(16), len(buf) - 1)].astype(np.uint32)
    ok = (rows[:, 0] == 0xFF) & ((rows[:, 1] & 0xFE) == 0xF8) & (at + 6 <= len(buf))
    size_code, rate_code, width_code = rows[:, 2] >> 4, rows[:, 2] & 15, (rows[:, 3] >> 1) & 7
    ok &= (rows[:, 3] >> 4 == 0) & (rows[:, 3] & 1 == 0) & (size_code > 0) & (rate_code < 15)
    ok &= np.isin(width_code, [0, *(k for k, v in _WIDTHS.items() if v == bits)])
    lead = rows[:, 4]
    n = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead < 0xFF], [1, 0, 2, 3, 4, 5, 6, 7], 0)
    ok &= n > 0
    number = np.where(n == 1, lead, lead & (0x7F >> np.minimum(n, 6))).astype(np.int64)
    for k in range(1, 7):
        use = k < n
        byte = rows[:, 4 + k]
        ok &= ~use | (byte >> 6 == 2)
        number = np.where(use, (number << 6) | (byte & 0x3F), number)
    extra = np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0))
    spot = (4 + n).astype(np.int64)
    pick = np.arange(len(rows))
    one, two = rows[pick, spot].astype(np.int64) + 1, ((rows[pick, spot].astype(np.int64) << 8) | rows[pick, np.minimum(spot + 1, 15)]) + 1
    sizes = np.where(size_code == 6, one, np.where(size_code == 7, two, np.array([_SIZES.get(k, 0) for k in range(16)])[size_code]))
    rate_extra = np.where(rate_code == 12, 1, np.where((rate_code == 13) | (rate_code == 14), 2, 0))
    length = np.minimum(spot + extra + rate_extra, 15)
    crc = crc8(rows, length)
    ok &= crc == rows[pick, length]
    return ok, length + 1, sizes.astype(np.int64), number


def find_frames(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, start, header length, block size) of all frames, each verified.

    begin and end bound the frames of each stream in the buffer. Places that look like
    a header are found by one vector search; a frame is a stretch from one to another
    whose CRC-16 is right. Coded samples may contain a header's pattern: then the
    stretch ends wrong, and the next place is tried.
    """
    place = np.flatnonzero((buf[:-1] == 0xFF) & ((buf[1:] & 0xFE) == 0xF8))
    owner = np.searchsorted(begin, place, "right") - 1
    inside = (owner >= 0) & (place < end[np.maximum(owner, 0)])
    place, owner = place[inside], owner[inside]
    ok, lengths, sizes, _ = _parse_headers(buf, place, bits)
    place, owner, lengths, sizes = place[ok], owner[ok], lengths[ok], sizes[ok]
    first = np.searchsorted(owner, np.arange(len(begin)))
    if (first >= len(owner)).any() or (place[first] != begin).any():
        raise ValueError("no frame where the first must be")
    stop = np.append(place[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = end[owner[last]]
    good = np.zeros(len(place), bool)
    for at in range(0, len(place), GROUP):
        a, e = place[at : at + GROUP], stop[at : at + GROUP]
        good[at : at + GROUP] = (crc16(buf, a, e - 2) == _two(buf, e - 2)) & (e - a > lengths[at : at + GROUP] + 2)
    if not good.all():
        keep = []
        for k in np.unique(owner[~good]).tolist():
            keep += _repaired(buf, np.flatnonzero(owner == k), place, int(end[k]))
        whole = np.isin(owner, np.unique(owner[~good]), invert=True)
        keep = np.sort(np.concatenate([np.flatnonzero(whole), np.array(keep, np.int64)]))
        owner, place, lengths, sizes = owner[keep], place[keep], lengths[keep], sizes[keep]
    return owner, place, lengths, sizes


def _two(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (buf[at].astype(np.uint32) << 8) | buf[at + 1]


def _repaired(buf: np.ndarray, own: np.ndarray, place: np.ndarray, end: int) -> list[int]:
    """The true frames among the possible ones of a stream, one after the other."""
    keep, i = [], 0
    while i < len(own):
        for j in range(i + 1, len(own) + 1):
            stop = np.array([(place[own[j]] if j < len(own) else end) - 2])
            if crc16(buf, place[own[i : i + 1]], stop)[0] == _two(buf, stop)[0]:
                break
        else:
            raise ValueError(f"frame {len(keep)} fails its checksum")
        keep.append(int(own[i]))
        i = j
    return keep


def decode_frames(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Samples (frames x largest size) of the frames whose subframes begin at byte at."""
    n, m = len(at), int(sizes.max(initial=0))
    x = np.zeros((n, m), np.int64)
    reader = _Bits(buf)
    pos = at * 8
    kind = reader.field(pos + 1, 6)
    wasted = reader.field(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        use = np.flatnonzero(wasted)
        wasted[use] = reader.zeros(pos[use]) + 1
        pos = pos + wasted
    width = bits - wasted
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a reserved subframe type")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    warm = np.where(kind == 0, 1, np.where(kind == 1, sizes, order))
    for i in range(int(warm.max(initial=0))):
        use = np.flatnonzero(i < warm)
        x[use, i] = _signed(reader.field(pos[use] + i * width[use], width[use]), width[use])
    pos = pos + warm * width
    const = np.flatnonzero(kind == 0)
    x[const] = x[const, :1]
    coefs, shift = np.zeros((n, int(order.max(initial=0)) or 1), np.int64), np.zeros(n, np.int64)
    if lpc.any():
        precision = np.where(lpc, reader.field(pos, 4) + 1, 0)
        shift = np.where(lpc, _signed(reader.field(pos + 4, 5), 5), 0)
        if (shift < 0).any():
            raise ValueError("a negative LPC shift")
        pos = pos + np.where(lpc, 9, 0)
        for k in range(int(order[lpc].max())):
            use = np.flatnonzero(lpc & (k < order))
            coefs[use, k] = _signed(reader.field(pos[use] + k * precision[use], precision[use]), precision[use])
        pos = pos + np.where(lpc, order * precision, 0)
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        x[coded] = _residuals(reader, pos[coded], sizes[coded], order[coded], np.ascontiguousarray(x[coded].T)).T
        _restore(x, coded, fixed, lpc, order, coefs, shift)
    return x << wasted[:, None]


def _residuals(reader: _Bits, pos, sizes, order, x) -> np.ndarray:
    """Rice residuals after the warm-up samples, one sample of all frames a step.

    x: samples by frames, with the warm-up samples in place.
    """
    method = reader.field(pos, 2)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    porder = reader.field(pos + 2, 4)
    pos = pos + 6
    param_bits = 4 + method
    escape = (1 << param_bits) - 1
    size = sizes >> porder
    k = np.zeros(len(pos), np.int64)
    raw = np.full(len(pos), -1)
    heads = {i for z in np.unique(size).tolist() for i in range(0, len(x), max(z, 1))}
    first, least, escaped, none = int(order.max()), int(sizes.min()), False, np.zeros(0, bool)
    for i in range(len(x)):
        fresh = np.zeros(0, bool)
        if i in heads:
            fresh = (i % np.maximum(size, 1) == 0) & (i < sizes)
        if fresh.any():
            f = np.flatnonzero(fresh)
            k[f] = reader.field(pos[f], param_bits[f])
            pos[f] += param_bits[f]
            out = f[k[f] == escape[f]]
            raw[f] = -1
            escaped = escaped or len(out) > 0
            if len(out):
                raw[out] = reader.field(pos[out], 5)
                pos[out] += 5
        if first <= i < least and not escaped:
            use, plain = slice(None), none
        else:
            live = (i >= order) & (i < sizes)
            plain = live & (raw >= 0)
            use = np.flatnonzero(live & ~plain)
        p, kk = pos[use], k[use]
        word = reader.window(p)
        q = reader.zeros(p, word)
        after = (q + 1).astype(np.uint64)
        if len(q) and q.max() + int(kk.max()) < 56:
            low = (word << after >> np.uint64(1) >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
        else:
            low = reader.field(p + q + 1, kk)
        u = (q << kk) | low
        x[i, use] = (u >> 1) ^ -(u & 1)
        pos[use] = p + q + 1 + kk
        if plain.any():
            f = np.flatnonzero(plain)
            x[i, f] = np.where(raw[f] > 0, _signed(reader.field(pos[f], raw[f]), np.maximum(raw[f], 1)), 0)
            pos[f] += raw[f]
    return x


def _restore(x, coded, fixed, lpc, order, coefs, shift) -> None:
    """Undo the predictors, in place."""
    for o in range(1, 5):
        use = np.flatnonzero(fixed & (order == o))
        if len(use):
            # The o-th difference is undone by o running sums, each begun by the
            # matching difference of the warm-up samples.
            r = x[use]
            begin = [r[:, :o]]
            for _ in range(o - 1):
                begin.append(np.diff(begin[-1], axis=1))
            r = r[:, o:]
            for d in range(o - 1, -1, -1):
                r = np.cumsum(np.concatenate([begin[d][:, -1:], r], 1), axis=1)[:, 1:]
            x[use, o:] = r
    for o in np.unique(order[lpc]).tolist():
        use = np.flatnonzero(lpc & (order == o))
        y = np.ascontiguousarray(x[use].T)
        c, s = coefs[use, :o].T, shift[use]
        for i in range(o, len(y)):
            acc = c[0] * y[i - 1]
            for k in range(1, o):
                acc = acc + c[k] * y[i - 1 - k]
            y[i] += acc >> s
        x[use] = y.T


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(samples, block starts) of each stream; raises ValueError on any damage."""
    infos = [read_info(s) for s in streams]
    if len({i.bits for i in infos}) > 1:
        return [decode_streams([s])[0] for s in streams]
    if not streams:
        return []
    bits = infos[0].bits
    ends = np.cumsum([len(s) for s in streams])
    begins = ends - [len(s) - i.frames_at for s, i in zip(streams, infos, strict=True)]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    owner, starts, heads, sizes = find_frames(buf, begins, ends, bits)
    parts: list[np.ndarray] = []
    for at in range(0, len(starts), GROUP):
        s = starts[at : at + GROUP]
        lo, hi = int(s[0]), int(starts[at + GROUP]) if at + GROUP < len(starts) else len(buf)
        part = decode_frames(buf[lo:hi], s + heads[at : at + GROUP] - lo, sizes[at : at + GROUP], bits)
        own = sizes[at : at + GROUP]
        parts.append(part.ravel() if (own == part.shape[1]).all() else part[np.arange(part.shape[1]) < own[:, None]])
    every = np.concatenate(parts).astype(np.int8 if bits == 8 else np.int16)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(owner, np.arange(len(streams) + 1))
    out = []
    for k, info in enumerate(infos):
        at = offsets[cut[k] : cut[k + 1] + 1]
        samples = every[at[0] : at[-1]]
        byte = starts[cut[k] : cut[k + 1]] - begins[k]
        for sample, offset, size in info.seek:
            if sample != (1 << 64) - 1:  # else a placeholder
                f = int(np.searchsorted(at - at[0], sample))
                if f >= len(byte) or at[f] - at[0] != sample or byte[f] != offset or sizes[cut[k] + f] != size:
                    raise ValueError(f"the seek point of sample {sample} is wrong")
        if info.n_samples and len(samples) != info.n_samples:
            raise ValueError("the number of samples is wrong")
        if any(info.md5) and hashlib.md5(samples.tobytes()).digest() != info.md5:
            raise ValueError("the samples fail the stream's MD5")
        out.append((samples, at[:-1] - at[0]))
    return out


# ---- columns ------------------------------------------------------------------------

_GROUP_BYTES = GROUP * BLOCK


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), filled with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def _groups(column: pa.Array, size) -> Iterator[list]:
    part, held = [], 0
    for v in column:
        v = v.as_py()
        if part and held + size(v) > _GROUP_BYTES:
            yield part
            part, held = [], 0
        part.append(v)
        held += size(v)
    if part:
        yield part


def encode_column(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "flac") -> DataFrame:
    """The kept columns, n_bytes of the text, and its payload as a FLAC stream.

    A null text is the empty one; rows are independent, so repeated rows, ties and an
    empty table pass through; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(batch.num_columns - 1), lambda t: len(t or "") + BLOCK):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                sizes = [len((t or "").encode()) for t in texts]
                media = encode_streams([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "n", "m"])

    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + (", " if keep else "") + "n long, m binary"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("n_bytes"), F.col("m").alias(name))


def decode_blocks(df: DataFrame, flac_col: str = "flac", id_col: str = "doc_id") -> DataFrame:
    """One row a PCM block: id, block number, sample offset, number of samples, pcm.

    pcm holds little-endian signed samples. A null stream has no blocks; a damaged one
    fails the job with a ValueError that names the damage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for streams in _groups(batch.column(1), lambda s: len(s or b"")):
                decoded = iter(decode_streams([s for s in streams if s is not None]))
                rows: list[list] = [[], [], [], [], []]
                for k, s in enumerate(streams):
                    if s is None:
                        continue
                    samples, starts = next(decoded)
                    for b, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(samples)], strict=True)):
                        for col, v in zip(rows, (at + k, b, lo, hi - lo, samples[lo:hi].tobytes()), strict=True):
                            col.append(v)
                at += len(streams)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *[pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=True)]], ["i", "block", "sample_offset", "n_samples", "pcm"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("i"), F.col(flac_col)).mapInArrow(run, f"i {kind}, block int, sample_offset long, n_samples int, pcm binary").withColumnRenamed("i", id_col)


def feature(samples: np.ndarray, n_blocks: int) -> str:
    """A short description of decoded samples, in whole numbers."""
    x = samples.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={n_blocks};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def digest_column(df: DataFrame, flac_col: str = "flac", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns and digests of the bytes read back from the stored streams."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for streams in _groups(batch.column(batch.num_columns - 1), len):
                rows = batch.slice(at, len(streams))
                at += len(streams)
                out: list[list] = [[] for _ in names]
                for s, (samples, starts) in zip(streams, decode_streams(streams), strict=True):
                    raw = (samples.view(np.uint8) ^ 0x80).tobytes()
                    got = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature(samples, len(starts)))
                    for col, v in zip(out, got, strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], [*batch.schema.names[:-1], *names])

    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(flac_col).alias("_flac"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *names)
