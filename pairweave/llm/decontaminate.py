"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of 13 words; an item of fewer words, but
not none, is one window.  A window is the set of its five-word shingles (all its
words if it has fewer).  Shingles are ordered by how often they occur in the
whole corpus, rarest first, then by hash.  A document that contains a window
contains all its shingles, so the necessary prefix is the rarest one: document
shingles are joined with prefixes only.  Each candidate must pass the positional
bound (the window, laid with its prefix on the match, starts inside the
document), the length bound (it also ends there), the equality of all word
hashes and then the equality of the words' bytes.

Windows are broadcast in blocks of at most ``BLOCK`` (about 60 MB); a larger
benchmark takes more blocks, which are chained as narrow stages, so there is no
shuffle of documents and no group of them.  Counts for the order are summed
within tasks before they are shuffled, one row a shingle and task.

Null or wordless texts have no words and no hits; rows are judged one by one, so
ties and repeated rows keep their rows; items without id or words are left out;
empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batched, ids_and_bytes, row_groups, views
from .storage import cut
from .words import lower, shingles, words

WINDOW, SHINGLE, BLOCK = 13, 5, 200_000


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and words (lower-cased, joined by one space) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = views(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in row_groups(at):
                part, low = data[at[i] : at[j]], lower(data[at[i] : at[j]]).tobytes()
                start, end, _, row = words(part, at[i : j + 1])
                first = np.searchsorted(row, np.arange(j - i + 1))
                out_id, out = [], []
                for k in range(j - i):
                    own = [low[a:b] for a, b in zip(start[first[k] : first[k + 1]].tolist(), end[first[k] : first[k + 1]].tolist())]
                    for s in range(max(1, len(own) - window + 1) if own else 0):
                        out_id.append(ids[i + k])
                        out.append(b" ".join(own[s : s + window]).decode("utf-8", "replace"))
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_pydict({"item_id": pa.array(out_id, pa.int64()), "words": pa.array(out, pa.string())})
                        out_id, out = [], []
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(out_id, pa.int64()), "words": pa.array(out, pa.string())})

    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return batched(rows, run, "item_id long, words string")


class Block:
    """Up to ``BLOCK`` distinct windows with the items of each, ready to be broadcast."""

    def __init__(self, rows: list):
        self.text = [r.words.encode() for r in rows]
        self.items = [list(r.items) for r in rows]
        keys = []
        for t in self.text:
            data = np.frombuffer(t, np.uint8)
            keys.append(words(data, np.array([0, len(data)]))[2])
        self.length = np.array([len(k) for k in keys], np.int64)
        self.keys = np.zeros((len(keys), int(self.length.max(initial=1))), np.uint64)
        for i, k in enumerate(keys):
            self.keys[i, : len(k)] = k
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(self.length, SHINGLE)).tolist():
            own = np.flatnonzero(np.minimum(self.length, SHINGLE) == n)
            found = [shingles(keys[i], n) for i in own]
            self.of[n] = (np.concatenate(found), np.concatenate([np.full(len(x), i) for x, i in zip(found, own)]), np.concatenate([np.arange(len(x)) for x in found]))
        self.distinct = {n: np.unique(x[0]) for n, x in self.of.items()}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of each window the rarest shingle, by (count in the corpus, hash)."""
        self.prefix = {}
        for n, (key, window, offset) in self.of.items():
            rarity = np.array([counts.get((n, i), 0) for i in range(len(self.distinct[n]))], np.int64)
            best = np.lexsort((offset, key, rarity[np.searchsorted(self.distinct[n], key)], window))
            best = best[np.unique(window[best], return_index=True)[1]]
            best = best[np.argsort(key[best], kind="stable")]
            self.prefix[n] = (Lookup(key[best]), window[best], offset[best])
        del self.of, self.distinct


class Lookup:
    """Sorted keys behind a table of bits, to sort out most of what isn't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``keys`` of what is there, and the range of equal keys of each."""
        at = np.flatnonzero(self.seen[(keys >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(self.keys, keys[at], "left")
        high = np.searchsorted(self.keys, keys[at], "right")
        ok = high > low
        return at[ok], low[ok], high[ok]


def _count(docs: DataFrame, shared) -> dict[tuple[int, int], int]:
    """Occurrences in all documents of each distinct shingle of a block, by (length, index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        look = {n: Lookup(x) for n, x in block.distinct.items()}
        total = {n: np.zeros(len(x), np.int64) for n, x in block.distinct.items()}
        for batch in batches:
            at, data = views(batch.column(1))
            for i, j in row_groups(at):
                _, _, key, row = words(data[at[i] : at[j]], at[i : j + 1])
                for n, own in look.items():
                    s = shingles(key, n)
                    pos, low, _ = own.find(s)
                    pos_ok = row[pos] == row[pos + n - 1]
                    total[n] += np.bincount(low[pos_ok], minlength=len(total[n]))
        for n, x in total.items():
            k = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(k), n, np.int64)), "i": pa.array(k), "count": pa.array(x[k])})

    # bounded: one row a shingle of the block, at most BLOCK * WINDOW
    rows = batched(docs, run, "n long, i long, count long").groupBy("n", "i").agg(F.sum("count").alias("count")).toArrow().to_pydict()
    return dict(zip(zip(rows["n"], rows["i"]), rows["count"]))


def _match(block: Block, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts, ends and rows, then row, first word and window of every occurrence."""
    start, end, key, row = words(data, at)
    first = np.searchsorted(row, np.arange(len(at)))
    got = []
    for n, (look, window, offset) in block.prefix.items():
        s = shingles(key, n)
        pos, low, high = look.find(s)
        many = high - low
        pos = np.repeat(pos, many)
        which = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        w = window[which]
        begin = pos - offset[which]
        of = row[pos]
        ok = (begin >= first[of]) & (begin + block.length[w] <= first[of + 1])
        got.append((begin[ok], w[ok], of[ok]))
    begin, w, of = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
    if len(begin):
        wide = np.arange(block.keys.shape[1])
        ok = np.ones(len(begin), bool)
        for a in range(0, len(begin), 1 << 16):
            b = slice(a, a + (1 << 16))
            here = key[np.minimum(begin[b, None] + wide, len(key) - 1)]
            ok[b] = ((here == block.keys[w[b]]) | (wide >= block.length[w[b], None])).all(1)
        begin, w, of = begin[ok], w[ok], of[ok]
    if len(begin):
        low_bytes = lower(data).tobytes()
        a, b, size = start.tolist(), end.tolist(), block.length[w].tolist()
        same = [b" ".join([low_bytes[a[k] : b[k]] for k in range(x, x + n)]) == block.text[y] for x, y, n in zip(begin.tolist(), w.tolist(), size)]
        begin, w, of = begin[same], w[same], of[same]
    return start, end, row, of, begin, w


_KINDS = "doc_id long, n_words long, hits binary, items array<long>"


def _apply(docs: DataFrame, shared, last: bool, again: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds a block's hits (a bit a word, packed) and items to those of the blocks before; the last columns are those to ``keep``."""
    kept = {c: f"{docs.schema[c].dataType.simpleString()}" for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            at, data = views(batch.column(1))
            out_words, out_hits, out_n, out_items = [], [], [], []
            old_hits = batch.column(2).to_pylist() if again else None
            old_items = batch.column(3).to_pylist() if again else None
            for i, j in row_groups(at):
                _, _, row, of, begin, w = _match(block, data[at[i] : at[j]], at[i : j + 1])
                cover = np.zeros(len(row) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + block.length[w], -1)
                hit = np.cumsum(cover[:-1]) > 0
                first = np.searchsorted(row, np.arange(j - i + 1))
                items: dict[int, set] = {}
                for r, x in set(zip(of.tolist(), w.tolist())):
                    items.setdefault(r, set()).update(block.items[x])
                for k in range(j - i):
                    own = hit[first[k] : first[k + 1]]
                    if again and old_hits[i + k] is not None:
                        own = own | np.unpackbits(np.frombuffer(old_hits[i + k], np.uint8), count=len(own)).astype(bool)
                        items.setdefault(k, set()).update(old_items[i + k])
                    out_words.append(len(own))
                    any_hit = own.any()
                    out_hits.append(np.packbits(own).tobytes() if any_hit else None)
                    out_n.append(int(own.sum()) if any_hit else 0)
                    out_items.append(sorted(items.get(k, ())))
            text = {} if last else {"text": batch.column(1)}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0)} | text | {"hits": pa.array(out_hits, pa.binary()), "items": pa.array(out_items, pa.list_(pa.int64())), "n_words": pa.array(out_words, pa.int64()), "n_hit": pa.array(out_n, pa.int64())}
                | {c: batch.column(batch.num_columns - len(keep) + k) for k, c in enumerate(keep)}
            )

    return batched(docs, run, "doc_id long, " + "text binary, " * (not last) + "hits binary, items array<long>, n_words long, n_hit long" + "".join(f", `{c}` {kind}" for c, kind in kept.items()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, hits (a bit a word, first word in the highest bit of the first byte; null for none), items (sorted ids), n_words, n_hit, the ``keep`` columns, contaminated."""
    spark = docs.sparkSession
    own = ids_and_bytes(docs, id_col, text_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *keep) if keep else own
    distinct = cut(windows(benchmark, window).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")))  # written once, read for each block
    blocks = max(1, -(-distinct.count() // block))
    part = F.pmod(F.xxhash64("words"), F.lit(blocks))
    for b in range(blocks):
        index = Block(distinct.filter(part == b).collect())  # about ``block`` windows
        count = spark.sparkContext.broadcast(index)
        counts = _count(own, count) if index.text else {}
        count.unpersist()
        index.order(counts)
        out = _apply(out, spark.sparkContext.broadcast(index), b == blocks - 1, b > 0, keep)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i + 1, i + {WINDOW}), ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM b, unnest(range(0, greatest(1, len(w) - {WINDOW - 1}))) AS u(i) WHERE len(w) > 0),
occurs AS (
  SELECT doc_id, item_id, i, n FROM (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win
    FROM d, (SELECT DISTINCT n FROM win) AS lengths, unnest(range(0, len(w) - n + 1)) AS u(i)) JOIN win USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occurs, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurs) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
