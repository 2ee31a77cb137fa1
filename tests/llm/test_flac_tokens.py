import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from packwright.llm import flac, tokenfiles


def back(streams):
    return [(s.view(np.uint8) ^ 0x80).tobytes() for s, _ in flac.decode_streams(streams)]


@settings(max_examples=40, deadline=None, database=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_round_trip(parts):
    payloads = [p + b"\xff" * (max(576, -(-len(p) // 576) * 576) - len(p)) for p in parts]
    assert back(flac.encode_streams(payloads)) == payloads


def test_all_subframe_kinds():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    wave = (128 + 90 * np.sin(np.arange(576 * 5) / 9) + rng.integers(-3, 4, 576 * 5)).astype(np.uint8).tobytes()
    ramp = (np.arange(576 * 2) // 7 % 256).astype(np.uint8).tobytes()
    payloads = [noise, wave, ramp, b"\x80" * 576 * 200]
    media = flac.encode_streams(payloads)
    assert back(media) == payloads
    assert len(media[1]) < 0.8 * len(wave) and len(media[3]) < 5000
    assert flac.read_info(media[3]).seek[1] == (64 * 576, 64 * 10, 576)  # 6 header bytes, 2 of subframe, 2 of CRC


def test_sine_like_sync_patterns_inside():
    # Payloads full of the bytes of a frame header.
    payload = (b"\xff\xf8\x20\x02\x00" * 2000)[: 576 * 17]
    assert back(flac.encode_streams([payload])) == [payload]


def test_damage_is_found():
    media = flac.encode_streams([random.Random(0).randbytes(576 * 9)])[0]
    for at in range(60, len(media), 211):
        bad = bytearray(media)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])
    for cut in (3, 20, len(media) - 5):
        with pytest.raises(ValueError):
            flac.decode_streams([media[:cut]])


def wide_stream():
    """A hand-made 16-bit stream: one LPC frame with escaped and 5-bit Rice partitions."""
    x = [100, -200] + [0] * 190
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += "0" + put(32 + 1, 6) + "0" + put(100, 16) + put(-200, 16)
    bits += put(4, 4) + put(0, 5) + put(1, 5) + put(-1, 5)  # precision 5, shift 0, coefs 1 and -1
    bits += put(1, 2) + put(1, 4)  # 5-bit parameters, two partitions
    resid = [(i * 37) % 61 - 30 for i in range(190)]
    bits += put(31, 5) + put(7, 5) + "".join(put(r, 7) for r in resid[:94])
    k = 3
    bits += put(k, 5)
    for r in resid[94:]:
        u = (r << 1) ^ (r >> 63)
        bits += "0" * (u >> k) + "1" + (put(u, k))
    for i in range(2, 192):
        x[i] = resid[i - 2] + x[i - 1] - x[i - 2]
    bits += "0" * (-len(bits) % 8)
    head = b"\xff\xf8" + bytes([0x10, 0x08]) + b"\x00"
    crc = 0
    for b in head:
        crc = int(flac._CRC8[crc ^ b])
    frame = head + bytes([crc]) + int(bits, 2).to_bytes(len(bits) // 8)
    c = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    frame += struct.pack(">H", c)
    info = (192).to_bytes(2) * 2 + bytes(6) + ((8000 << 44) | (15 << 36) | 192).to_bytes(8) + hashlib.md5(np.array(x, "<i2").tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3) + info + frame, x


def test_a_foreign_stream():
    stream, x = wide_stream()
    samples, starts = flac.decode_streams([stream])[0]
    assert samples.tolist() == x and starts.tolist() == [0]


def plain_crc(data, bits, poly):
    r = 0
    for byte in data:
        r ^= byte << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r >> (bits - 1) else r << 1) & ((1 << bits) - 1)
    return r


def test_checksums():
    data = np.frombuffer(random.Random(3).randbytes(301), np.uint8)
    a, b = np.array([0, 5, 7]), np.array([301, 6, 7])
    assert flac.crc16(data, a, b).tolist() == [plain_crc(data[i:j].tolist(), 16, 0x8005) for i, j in zip(a, b, strict=True)]


def test_columns(spark):
    texts = ["", None, "a", "é" * 400, "x" * 576, "y" * 5000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    media = flac.encode_column(df)
    for r in flac.digest_column(media).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = flac.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert len(payload) % 576 == 0 and len(payload) - len(raw) < 576 + (not raw) and r.tail_crc32 == zlib.crc32(payload[-32:])
    blocks = flac.decode_blocks(media).where("doc_id = 5").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [576 * i for i in range(9)]
    assert bytes(v ^ 0x80 for b in blocks for v in b.pcm) == flac.payload_of("y" * 5000)
    assert flac.digest_column(flac.encode_column(df.limit(0))).count() == 0


def brute_scan(tokens, eod):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == eod:
            out.append((start, i - start))
            start = i + 1
    return out + ([(start, len(tokens) - start)] if start < len(tokens) else [])


@pytest.mark.parametrize(("dtype", "max_whole"), [("uint16", 1 << 30), ("uint32", 1 << 30), ("int64", 1 << 30), ("uint32", 200)])
def test_scan_is_the_plain_loop(spark, tmp_path, dtype, max_whole):
    rng = random.Random(7)
    want = {}
    for f in range(6):
        tokens = [rng.choice([0, 1, 2, 9] if f else [1]) for _ in range([400, 0, 1, 64, 129, 63][f])]
        if f == 3:
            tokens[-1] = 9
        (tmp_path / f"{f}.bin").write_bytes(np.array(tokens, tokenfiles.DTYPES[dtype]).tobytes())
        want[f] = brute_scan(tokens, 9)
    blocks = tokenfiles.blocks_of_files(spark, str(tmp_path), dtype, 16, max_whole=max_whole, range_blocks=3)
    got = {f: [] for f in want}
    for r in tokenfiles.scan_separators(blocks, 9, dtype).orderBy("file", "number").collect():
        own = got[int(r.file.rsplit("/", 1)[1][0])]
        assert r.number == len(own)
        own.append((r.start, r.n_tokens))
    assert got == want


def test_counts_equal_the_tokenizer(spark, tmp_path):
    import tiktoken

    texts = ["one two three", "", None, "  spaces\n\nand lines ", "long " * 3000, "<|endoftext|>", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    enc = tiktoken.Encoding("t", pat_str=tokenfiles.PATTERN, mergeable_ranks=tokenfiles.load_ranks(tokenfiles.TOKENIZER), special_tokens={})
    got = {r.doc_id: r.n_tokens for r in tokenfiles.token_counts(df, str(tmp_path / "t")).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert tokenfiles.token_counts(df.limit(0), str(tmp_path / "e")).count() == 0


def test_whole_tokens_only(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        tokenfiles.blocks_of_files(spark, str(tmp_path), "uint16").collect()
