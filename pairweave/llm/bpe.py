"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

``Encoder`` splits a text by the tokenizer's pattern and encodes every match by
itself.  Matches that are not in its cache are gathered over the whole batch,
put into int32 matrices of equal width, one row a match, and merged in rounds:
a hashed pair table gives each adjacent pair's rank, every row merges its
leftmost pair of the least rank, and the row is compacted by one place.  Rows
without a mergeable pair leave the matrix.  A match longer than the widest
bucket takes the same merges from a heap, as rounds over it would be quadratic.

Null and empty texts have no ids.  Bytes that are not UTF-8 are replaced as by
``bytes.decode(errors="replace")``.  The result depends on the text alone, so
ties and repeated rows need no rule; the other columns are not read.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import ids_and_bytes, map_batches, texts

WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
CACHE_TOKENS = 150_000
_WIDTH_OF = [min(w for w in WIDTHS if w >= n) for n in range(WIDTHS[-1] + 1)]
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Ranks of (left id, right id) in an open-addressed numpy hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.probes = 1
        todo, slot, step = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            place = (slot[todo] + step) & (size - 1)
            free = self.ranks[place] == _NONE
            place_free, who = place[free], todo[free]
            _, first = np.unique(place_free, return_index=True)
            self.keys[place_free[first]] = keys[who[first]]
            self.ranks[place_free[first]] = np.array(merged, np.int32)[who[first]]
            todo = np.setdiff1d(todo, who[first])
            step += 1
            self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found == _NONE).ravel() & (self.ranks[slot] != _NONE).ravel())
        flat, k, s = found.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        for step in range(1, self.probes):
            if not len(open_):
                break
            place = (s[open_] + step) & (len(self.keys) - 1)
            hit = self.keys[place] == k[open_]
            flat[open_[hit]] = self.ranks[place[hit]]
            open_ = open_[~hit & (self.ranks[place] != _NONE)]
        return found


class Encoder:
    """Encodes and decodes with one vocabulary; keep one a process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_of[rank] = token
        self.cache: dict[str, bytes] = {}

    def _merge_matrix(self, tokens: list[bytes], width: int) -> list[bytes]:
        n = len(tokens)
        length = np.fromiter(map(len, tokens), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in tokens), np.uint8).reshape(n, width)
        ids = self.of_byte[raw]
        columns = np.arange(width)
        alive, out_ids, out_length = np.arange(n), ids.copy(), length.copy()
        pair = self.table.look_up(ids[:, :-1], ids[:, 1:])
        pair[columns[None, 1:] >= length[:, None]] = _NONE
        while len(alive):
            at = pair.argmin(1)
            rows = np.arange(len(alive))
            rank = pair[rows, at]
            go = rank != _NONE
            if not go.all():
                stop = ~go
                out_ids[alive[stop]], out_length[alive[stop]] = ids[stop], length[stop]
                alive, ids, length, pair, at, rank = alive[go], ids[go], length[go], pair[go], at[go], rank[go]
                rows = np.arange(len(alive))
                if not len(alive):
                    break
            tail = columns[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            ids[rows, at] = rank
            length -= 1
            pair[:, :-1] = np.where(tail[:, :-1], pair[:, 1:], pair[:, :-1])
            pair[:, -1] = _NONE
            nxt = np.minimum(at + 1, width - 1)
            right = self.table.look_up(ids[rows, at], ids[rows, nxt])
            right[at + 1 >= length] = _NONE
            inner = at < width - 1
            pair[rows[inner], at[inner]] = right[inner]
            before = at > 0
            pair[rows[before], at[before] - 1] = self.table.look_up(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])
        flat = out_ids.astype("<u4")
        return [flat[i, : out_length[i]].tobytes() for i in range(n)]

    def _merge_long(self, token: bytes) -> bytes:
        ranks, n = self.ranks, len(token)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def rank_at(i: int) -> int | None:
            j = after[i]
            return ranks.get(token[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, to = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != to or end[i] >= to:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_at(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return np.array([ranks[token[i : end[i]]] for i in range(n) if alive[i]], "<u4").tobytes()

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each token, which the pattern has split off already."""
        out: list[bytes] = [b""] * len(tokens)
        bucket: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            if (whole := self.ranks.get(token)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(token) > WIDTHS[-1]:
                out[i] = self._merge_long(token)
            else:
                bucket.setdefault(_WIDTH_OF[len(token)], []).append(i)
        for width, members in bucket.items():
            for at in range(0, len(members), 1 << 14):
                part = members[at : at + (1 << 14)]
                for i, ids in zip(part, self._merge_matrix([tokens[i] for i in part], width)):
                    out[i] = ids
        return out

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        find, cache, out = self.pattern.findall, self.cache, []
        for group in _by_size(batch, 1 << 20):
            found = [find(x.decode("utf-8", "replace")) for x in group]
            new = list(set().union(*found).difference(cache))
            if len(cache) + len(new) > CACHE_TOKENS:
                cache.clear()
                new = list(set().union(*found))
            cache.update(zip(new, self.encode_tokens([x.encode() for x in new])))
            out += [b"".join(map(cache.__getitem__, x)) for x in found]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _by_size(batch: list[bytes], limit: int):
    group, size = [], 0
    for x in batch:
        if group and size + len(x) > limit:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


_held: dict[tuple, Encoder] = {}


def encoder(shared) -> Encoder:
    """This process's encoder for a broadcast (ranks, pattern, name)."""
    ranks, pattern, name = shared.value
    key = (name, len(ranks), pattern)
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(ranks, pattern)
    return _held[key]


def share(spark, path: str, pattern: str):
    """Broadcast a vocabulary: its size is fixed by the tokenizer (about 50,000 tokens, 1 MB), whatever the corpus."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern, path))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    shared = share(df.sparkSession, path, pattern)

    def each(batch: pa.RecordBatch) -> dict:
        ids = encoder(shared).encode(texts(batch.column(1)))
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}

    return map_batches(ids_and_bytes(df, id_col, text_col), each, "doc_id long, ids binary, n_tokens long")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of doc_id and ids."""
    shared = share(df.sparkSession, path, pattern)

    def each(batch: pa.RecordBatch) -> dict:
        own = encoder(shared)
        return {"doc_id": batch.column(0), "bytes": pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())}

    return map_batches(df.select("doc_id", "ids"), each, "doc_id long, bytes binary")


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, ids, n_tokens and the bytes decoded from the ids."""
    shared = share(df.sparkSession, path, pattern)

    def each(batch: pa.RecordBatch) -> dict:
        own = encoder(shared)
        ids = own.encode(texts(batch.column(1)))
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "bytes": pa.array([own.decode(x) for x in ids], pa.binary())}

    return map_batches(ids_and_bytes(df, id_col, text_col), each, "doc_id long, ids binary, n_tokens long, bytes binary")
