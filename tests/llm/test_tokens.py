"""Media columns, BPE and packing: round trips and comparison with public libraries."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairweave.llm import bpe, media, packing
from pairweave.llm.registry import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
TEXTS = [None, "", "a", "é" * 70, "The quick  brown\n\nfox's 12345 ＡＢ 漢字 😀\t", "x" * 5000, "ab" * 900 + " ", " " * 3000 + "z", "same text here", "same text here", "word " * 20000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 5, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "null id", "en", "s", 1, 1, 1), (8, "same text here", "en", "s", 5, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, media int, ids int")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_is_tiktokens(docs, reference):
    rows = bpe.encode_decode(docs, PATH, PATTERN).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, hashlib.sha256(bytes(r.bytes)).hexdigest()): r for r in rows}
    for d in docs.collect():
        text = d.text or ""
        r = by[d.doc_id, hashlib.sha256(text.encode()).hexdigest()]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(text) and r.n_tokens == len(r.ids) // 4
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in got) == sorted((d.text or "").encode() for d in docs.collect())
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_bpe_on_random_texts(reference):
    own, r = bpe.Encoder(bpe.read_ranks(PATH), PATTERN), random.Random(1)
    odd = ["".join(r.choice("abc the\n  \t.,;éß漢字😀12'") for _ in range(r.randint(0, 300))).encode() for _ in range(1500)]
    odd += [b"a" * n for n in (127, 128, 129, 1000)] + [bytes(("é" * 999), "utf-8")]
    for text, ids in zip(odd, own.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text.decode())
        assert own.decode(ids) == text
    bpe_cache = bpe.CACHE_TOKENS
    bpe.CACHE_TOKENS = 10
    try:
        assert own.encode(odd) == bpe.Encoder(own.ranks, PATTERN).encode(odd)
    finally:
        bpe.CACHE_TOKENS = bpe_cache


def test_pair_table():
    ranks = bpe.read_ranks(PATH)
    table = bpe.PairTable(ranks)
    tokens = [t for t in ranks if 2 <= len(t) <= 6][:3000]
    for t in tokens[::50]:
        for cut in range(1, len(t)):
            if t[:cut] in ranks and t[cut:] in ranks:
                assert table.look_up(np.array([ranks[t[:cut]]]), np.array([ranks[t[cut:]]]))[0] == ranks[t]
    assert table.look_up(np.array([50255]), np.array([50255]))[0] == bpe._NONE


def test_text_media(docs):
    rows = media.text_media(docs).collect()
    want = {(d.doc_id, d.text or "") for d in docs.collect()}
    assert len(rows) == docs.count()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.payload_sha256), r)
    for doc, text in want:
        raw = text.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[doc, hashlib.sha256(padded).hexdigest()]
        stored = media.pgm(media.payload(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.feature) == 16
    assert media.text_media(docs.limit(0)).count() == 0


def test_netpbm():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n")[..., 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[..., 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 15 3")[..., 0].tolist() == [[255, 51]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x80\x00")[0, 0, 0] == 128
    assert media.decode(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n\x01\x02\x03\x04").tolist() == [[[1, 2, 3, 4]]]
    for bad in (b"", b"P5", b"P5\n2 2\n255\nabc", b"P5\n0 2\n255\n", b"GIF89a", b"BM", b"P9 1 1"):
        with pytest.raises(ValueError):
            media.decode(bad)


def bmp(pixels, bits, palette=b"", how=0, w=2, h=2):
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(pixels), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, how, len(pixels), 0, 0, len(palette) // 4, 0) + palette + pixels


def test_bmp():
    want = [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]]
    assert media.decode(bmp(bytes([9, 8, 7, 12, 11, 10, 0, 0, 3, 2, 1, 6, 5, 4, 0, 0]), 24)).tolist() == want
    assert media.decode(bmp(bytes([3, 2, 1, 6, 5, 4, 0, 0, 9, 8, 7, 12, 11, 10, 0, 0]), 24, h=-2)).tolist() == want
    palette = bytes([3, 2, 1, 0, 6, 5, 4, 0, 9, 8, 7, 0, 12, 11, 10, 0])
    assert media.decode(bmp(bytes([2, 3, 0, 0, 0, 1, 0, 0]), 8, palette)).tolist() == want
    assert media.decode(bmp(bytes([0x23, 0, 0, 0, 0x01, 0, 0, 0]), 4, palette)).tolist() == want
    assert media.decode(bmp(bytes([1, 2, 1, 3, 0, 0, 1, 0, 1, 1, 0, 1]), 8, palette, 1)).tolist() == want
    assert media.decode(bmp(bytes([2, 0x23, 0, 0, 2, 0x01, 0, 1]), 4, palette, 2)).tolist() == want
    assert media.decode(bmp(bytes([0x40, 0, 0, 0, 0x80, 0, 0, 0]), 1, palette[:8]))[..., 0].tolist() == [[4, 1], [1, 4]]


def test_resize_is_the_exact_area_average(monkeypatch):
    from fractions import Fraction

    r = np.random.default_rng(0)
    for h, w, th, tw in ((5, 7, 3, 2), (3, 3, 8, 9), (64, 64, 8, 8), (1, 1, 4, 4), (10, 64, 8, 9)):
        image = r.integers(0, 256, (h, w, 1)).astype(np.uint8)

        def overlap(i, n, k, m):
            return max(Fraction(0), min(Fraction(i + 1), Fraction((k + 1) * n, m)) - max(Fraction(i), Fraction(k * n, m)))

        want = [[int(sum(int(image[y, x, 0]) * overlap(y, h, a, th) * overlap(x, w, b, tw) for y in range(h) for x in range(w)) * th * tw / (h * w) + Fraction(1, 2)) for b in range(tw)] for a in range(th)]
        assert media.resize(image, th, tw)[..., 0].tolist() == want
        for block in (4, 150):
            monkeypatch.setattr(media, "_BLOCK", block)
            assert media.resize(image, th, tw)[..., 0].tolist() == want
        monkeypatch.undo()


def test_large_and_false_sizes():
    wide = np.random.default_rng(0).integers(0, 256, (3, 400_000, 3), np.uint8)
    high = wide.transpose(1, 0, 2)
    tracemalloc.start()
    a, b = media.resize(wide, 32, 32), media.resize(high, 32, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (a == b.transpose(1, 0, 2)).all() and peak < 64 << 20
    head = lambda w, h, how, bits: b"BM" + struct.pack("<IHHI", 56, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, how, 0, 0, 0, 0, 0)
    for odd in (head(2**31 - 1, 2**31 - 1, 1, 8) + b"\0\1", head(2**31 - 1, 2**31 - 1, 0, 24), b"P6 99999999999 99999999999 255\n", b"P4 99999999 99999999\n", b"P3 99999999 99999999 255\n1"):
        with pytest.raises(ValueError):
            media.decode(odd)


def test_media_columns(spark):
    df = spark.createDataFrame([(0, bytearray(b"P5\n2 1\n255\n\x00\xff"), 1), (1, None, 2), (2, bytearray(b"junk"), 3)], "id long, media binary, width long")
    a, b, c = sorted(media.media_columns(df, keep=("id",), tile=2, samples=True).collect())
    assert (a.width, a.height, a.channels, bytes(a.samples), a.error) == (2, 1, 1, b"\x00\xff", None)
    import io

    assert np.load(io.BytesIO(bytes(a.tile)))[..., 0].tolist() == [[0, 255], [0, 255]] and a.dhash == "1818181818181818"
    assert b.width is None and b.error and c.tile is None and c.error


def test_segment_tree_is_best_fit():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.choice([1, 7, 8, 100])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 60))), reverse=True)
        rooms, rows = [], []
        for i, n in enumerate(sizes):
            fits = [(x, k) for k, x in enumerate(rooms) if x >= n]
            if fits:
                _, k = min(fits)
                rows[k].append(i)
                rooms[k] -= n
            else:
                rows.append([i])
                rooms.append(capacity - n)
        assert packing.best_fit(sizes, capacity) == rows


@pytest.mark.parametrize("capacity,pool", [(16, 200), (2048, 2_000_000)])
def test_packing_round_trip(docs, reference, capacity, pool):
    packed = packing.pack(docs, PATH, PATTERN, capacity, pool).cache()
    rows = packed.collect()
    for r in rows:
        assert len(r.ids) == len(r.positions) == 4 * capacity and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= capacity
        at = np.frombuffer(bytes(r.positions), "<i4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[a:b].tolist() == list(range(b - a))
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    by: dict = {}
    for r in packing.unpack(packed).collect():
        by.setdefault(r.doc_id, []).append((r.offset, bytes(r.ids)))
    for d in docs.collect():
        want = np.array(reference.encode_ordinary(d.text or ""), "<i4").tobytes()
        pieces = sorted(set(by.get(d.doc_id, [])))
        assert b"".join(x for _, x in pieces) == want
    assert sum(len(x) for x in by.values()) == sum(-(-len(reference.encode_ordinary(d.text or "")) // capacity) for d in docs.collect())
    assert packing.pack(docs.limit(0), PATH, PATTERN).count() == 0
    assert {"shard", "row", "doc_ids", "n_padding"} <= set(packing.digest(packed).columns)


def test_rows_of_equal_doc_id_are_told_apart(spark, reference):
    texts = ["one two three four five " * 40, "six seven eight nine ten " * 40, "one two three four five " * 40, "", None]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").coalesce(1)
    rows = {}
    for r in packing.unpack(packing.pack(df, PATH, PATTERN, capacity=16, pool=100)).collect():
        rows.setdefault(r.input_row, []).append((r.offset, bytes(r.ids)))
    got = sorted(b"".join(x for _, x in sorted(own)) for own in rows.values())
    assert got == sorted(np.array(reference.encode_ordinary(t), "<i4").tobytes() for t in texts if t)
