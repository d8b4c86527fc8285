"""Token ids packed into rows of one length: best-fit decreasing, with a segment tree.

Documents are encoded and cut, without loss, into pieces of at most ``capacity``
tokens.  A task gathers pieces up to ``pool`` tokens, packs them and goes on, so
its memory is bounded and nothing is shuffled.  Pieces are placed from the
longest on, ties by doc_id and offset, each into the open row of the least
remaining room that still holds it (of equal ones the first opened).  Room is
searched in a segment tree over the possible remaining capacities.

A packed row has ids (int32, little-endian, padded to ``capacity``), cu_seqlens
(cumulative segment lengths from 0), positions (int32, starting at 0 in every
segment, 0 in the padding) and the doc_ids, offsets and input_rows of its
segments, from which ``unpack`` gives every document back.

Null and empty texts have no tokens and no piece.  Repeated rows, and rows of
equal doc_id, are packed each by itself; input_rows, a number of the row among
those of its task, tells their pieces apart.  Pools follow the partitions of the
table, so other file splits give other rows of the same documents.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batched, ids_and_bytes, texts
from .bpe import share

CAPACITY, POOL, PAD = 2048, 2_000_000, 0


class Room:
    """The open rows by remaining capacity: the least capacity >= n that some row has, in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        heapq.heappush(self.rows[room], row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(row, its room) of the best fit, taken out, or None."""
        node, count = n + self.leaves, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        self._change(room, -1)
        return heapq.heappop(self.rows[room]), room


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The pieces (places in ``sizes``, which decreases) of each row."""
    room, rows = Room(capacity), []
    for i, n in enumerate(sizes):
        found = room.take(n) if n < capacity else None
        if found is None:
            found = (len(rows), capacity)
            rows.append([])
        rows[found[0]].append(i)
        if found[1] > n:
            room.add(found[1] - n, found[0])
    return rows


def _pack(pieces: list, capacity: int, shard: int, pad: int) -> pa.RecordBatch:
    pieces.sort(key=lambda x: (-len(x[2]), x[0] is None, x[0] or 0, x[1], x[3]))
    rows = best_fit([len(x[2]) for x in pieces], capacity)
    ids = np.full((len(rows), capacity), pad, "<i4")
    positions = np.zeros((len(rows), capacity), "<i4")
    cuts, docs, offsets = [], [], []
    for r, members in enumerate(rows):
        at, cut = 0, [0]
        for i in members:
            own = pieces[i][2]
            ids[r, at : at + len(own)] = own
            positions[r, at : at + len(own)] = np.arange(len(own))
            at += len(own)
            cut.append(at)
        cuts.append(cut)
        docs.append([pieces[i][0] for i in members])
        offsets.append([pieces[i][1] for i in members])
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard] * len(rows), pa.int64()),
            "row": pa.array(range(len(rows)), pa.int64()),
            "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            "cu_seqlens": pa.array(cuts, pa.list_(pa.int32())),
            "positions": pa.array([x.tobytes() for x in positions], pa.binary()),
            "doc_ids": pa.array(docs, pa.list_(pa.int64())),
            "offsets": pa.array(offsets, pa.list_(pa.int64())),
            "input_rows": pa.array([[pieces[i][3] for i in members] for members in rows], pa.list_(pa.int64())),
        }
    )


_held: dict[str, tiktoken.Encoding] = {}


def pack(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, pool: int = POOL, pad: int = PAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all texts; (shard, row) tells rows apart, a shard being a pool of a task."""
    shared = share(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern, name = shared.value
        if name not in _held:
            _held[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _held[name].encode_to_numpy
        pieces, held = [], 0
        shard = TaskContext.get().partitionId() << 24
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = encode(text.decode("utf-8", "replace"), disallowed_special=()).astype("<i4")
                row += 1
                for at in range(0, len(ids), capacity):
                    pieces.append((doc, at, ids[at : at + capacity], row))
                    held += len(pieces[-1][2])
                    if held >= pool:
                        yield _pack(pieces, capacity, shard, pad)
                        pieces, held, shard = [], 0, shard + 1
        if pieces:
            yield _pack(pieces, capacity, shard, pad)

    return batched(ids_and_bytes(df, id_col, text_col), run, "shard long, row long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, offsets array<long>, input_rows array<long>")


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, input_row, offset and the ids (binary) of every segment: ordered by offset, an input row's are its ids."""
    ends = [F.slice("cu_seqlens", F.lit(k), F.size("doc_ids")).alias(name) for k, name in ((1, "at"), (2, "to"))]
    each = packed.select("ids", F.explode(F.arrays_zip("doc_ids", "input_rows", "offsets", *ends)).alias("x"))
    return each.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.input_rows").alias("input_row"), F.col("x.offsets").alias("offset"), F.substring("ids", F.col("x.at") * 4 + 1, (F.col("x.to") - F.col("x.at")) * 4).alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "shard",
        "row",
        "doc_ids",
        "offsets",
        "cu_seqlens",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        (F.length("ids") / 4 - F.element_at("cu_seqlens", -1)).cast("long").alias("n_padding"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )
