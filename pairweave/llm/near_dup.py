"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is its words (see ``words``); its features are the five-word shingles
(all its words if it has fewer), weighted (1 + ln tf) * ln(e + N / df).
df counts groups of copies rather than copies: a text adds 1 / m to it and to N,
m being how many texts are about the same.  Otherwise what a large group of near
copies shares would weigh little and its members' own edits much, the more so the
larger the group and the corpus.  m is the largest count among the text's ``MINIMA``
least hashes of shingles, 1 at least: a near copy has eight or nine in ten of them
in common with the text it was made from, so next to none counts as a text of its
own.  The counts are kept by hash in ``SLOTS`` slots a least hash, less what others
add to a slot on average; the scatter that is left makes m larger for all texts alike.

df is that of the shingle, from a sketch of fixed size: each of ``SKETCHES`` rows
sums df by hash into ``BUCKETS`` buckets, what other shingles add to a bucket on
average is taken off, and the middle one of the rows' values counts, 1 at least.
A row is off by more than k * sqrt(sum of all df squared / BUCKETS) for at most
1 / k^2 of the shingles, the middle one of three for at most 3 / k^4.

``REPEATS`` times, the shingles are dealt by hash to ``BINS`` bins and improved
consistent weighted sampling takes one (shingle, level) of each bin; empty bins
borrow from the next.  ``ROWS`` samples make a band.  Documents that share a
band are candidates, and candidates of a weighted Jaccard similarity of 0.8 or
more, computed from the whole texts, are linked; classes are the connected
components of links.

Texts of equal words are one node from the start, however many they are.  A
candidate more than a fifth of whose weight is in shingles that no other
candidate has can't reach 0.8 with any and leaves before texts are compared.
Within a band's bucket the pairs aren't listed: in each round some pivots a
bucket are compared with the members that aren't in their component yet, unless
weights and shares of rare shingles rule 0.8 out for the pair; texts that have a
shingle to themselves as two are compared at once.  First the member with the least weight of its own is the pivot,
then a few more, then all that are outside the bucket's largest component, more
in each round, until every pair of two components has been compared.  So a round
is linear in a bucket, there are as many rounds as the logarithm of the members
left alone, and no link that would join two components is left out.

Each row gets class_id, the least doc_id of its class, by its own text, whatever other
rows share its doc_id.  A null doc_id's class is null, and its text joins no others; a
text without words, null or empty, is a class of its own.  Repeated rows share their
class.  Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import batched, row_groups, views
from .skew import salted_join
from .storage import cut, remove
from .words import mix, row_shingles, words

SHINGLE, THRESHOLD = 5, 0.8
BUCKETS, SKETCHES, PIECE = 1 << 18, 3, 1 << 14
MINIMA, SLOTS, UNIT = 8, 1 << 18, 1 << 20
REPEATS, BINS, ROWS = 4, 25, 5
HUBS, PIVOTS = 3, 8
#: So many edges are solved by one task at once; more of them in rounds over the whole table.
EDGES = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of the distinct shingles of each row, sorted so; and two content hashes a row (0 for no words)."""
    n = len(offsets) - 1
    _, _, key, row = words(data, offsets)
    shingle, of = row_shingles(key, row, n, SHINGLE)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(of)))
    content = np.zeros((2, n), np.uint64)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        place = mix(nth.astype(np.uint64) + np.uint64(1))
        with_place = mix(key ^ place)
        content[0, row[first]] = np.add.reduceat(with_place, first)
        content[1, row[first]] = np.add.reduceat(mix(with_place * np.uint64(0xD6E8FEB86659FD93) + place), first)
    return of[at], shingle[at], tf, content[0], content[1]


def _buckets(shingle: np.ndarray) -> list[np.ndarray]:
    """The bucket of each shingle in each row of the sketch, from bits of their own."""
    x = mix(shingle)
    return [((x >> np.uint64(20 * k)) % np.uint64(BUCKETS)).astype(np.int64) for k in range(SKETCHES)]


def weights(shingle: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Multiples of 2^-16, so sums are exact in any order and a similarity that is just the threshold counts as such."""
    a, b, c = (row[at] for row, at in zip(idf, _buckets(shingle)))
    return np.rint((1 + np.log(tf)) * np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)) * 65536) / 65536


def _summed(own: DataFrame, length: int, add_to: Callable[[np.ndarray, np.ndarray, np.ndarray, int], None]) -> np.ndarray:
    """``length`` sums over all texts; ``add_to`` adds those of some texts, given as row and shingle of their distinct shingles.  They reach the driver in compressed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            at, data = views(batch.column(0))
            for i, j in row_groups(at):
                of, shingle, _, _, _ = features(data[at[i] : at[j]], at[i : j + 1])
                add_to(total, of, shingle, j - i)
        pieces = total.reshape(-1, PIECE)
        k = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(k.astype(np.int32)), "sums": pa.array([pieces[x].tobytes() for x in k], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(PIECE, np.int64)
        for x in table.column("sums"):
            sums += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"piece": table.column("piece")[:1], "sums": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    got = batched(own.select("text"), run, "piece int, sums binary").groupBy("piece").applyInArrow(add, "piece int, sums binary").toArrow()
    out = np.zeros(length, np.int64)
    for k, x in zip(got.column("piece").to_pylist(), got.column("sums").to_pylist()):
        out.reshape(-1, PIECE)[k] = np.frombuffer(zlib.decompress(x), np.int64)
    return out


def _slots(of: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that have shingles, and the slots of their least hashes."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    if not len(first):
        return first, [first] * MINIMA
    least = [np.minimum.reduceat(mix(shingle ^ np.uint64((0x9FB21C651E98DF25 * (m + 1)) % 2**64)), first) for m in range(MINIMA)]
    return of[first], [(mix(x) % np.uint64(SLOTS)).astype(np.int64) + m * SLOTS for m, x in enumerate(least)]


def group_sizes(own: DataFrame) -> np.ndarray:
    """MINIMA * SLOTS counts of texts by their least hashes, less what others add to a slot on average, 1 at least."""

    def add_to(total: np.ndarray, of: np.ndarray, shingle: np.ndarray, n: int) -> None:
        for slot in _slots(of, shingle)[1]:
            np.add.at(total, slot, 1)

    counts = _summed(own, MINIMA * SLOTS, add_to)
    total = counts[:SLOTS].sum()
    out = np.empty(len(counts), np.float32)
    for own_counts, sizes in zip(counts.reshape(MINIMA, SLOTS), out.reshape(MINIMA, SLOTS)):
        sizes[:] = np.maximum(own_counts - (total - own_counts) / (SLOTS - 1), 1)
    return out


def document_frequencies(own: DataFrame) -> np.ndarray:
    """The sketch's rows, each the sums of df by bucket with N after them, in groups of copies; SKETCHES * BUCKETS numbers reach the driver."""
    width = BUCKETS + PIECE  # N has a piece of its own
    sizes = own.sparkSession.sparkContext.broadcast(group_sizes(own))  # MINIMA * SLOTS floats, 8 MB

    def add_to(total: np.ndarray, of: np.ndarray, shingle: np.ndarray, n: int) -> None:
        rows, slots = _slots(of, shingle)
        share = np.full(n, UNIT)  # whole numbers, so the order of sums doesn't matter
        share[rows] = np.maximum(np.rint(UNIT / np.maximum.reduce([sizes.value[x] for x in slots])), 1)
        total = total.reshape(SKETCHES, width)
        for row, bucket in zip(total, _buckets(shingle)):
            row[:BUCKETS] += np.bincount(bucket, share[of], minlength=BUCKETS).astype(np.int64)
        total[:, BUCKETS] += share.sum()

    out = _summed(own, SKETCHES * width, add_to).reshape(SKETCHES, width)[:, : BUCKETS + 1] / UNIT
    sizes.destroy()
    return out


def inverse_frequencies(df: np.ndarray) -> np.ndarray:
    sums, n = df[:, :BUCKETS], float(df[0, BUCKETS])
    others = (sums.sum(1, keepdims=True) - sums) / (BUCKETS - 1)
    own = np.clip(sums - others, 1, max(n, 1))
    return np.log(np.e + n / own)


def _uniform(x: np.ndarray, k: int) -> np.ndarray:
    return (((x >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)).astype(np.float64) + 0.5) / (1 << 21)


def samples(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, REPEATS * BINS) sample hashes; rows without shingles are 0."""
    out = np.zeros((n, REPEATS, BINS), np.uint64)
    log_w = np.log(weight)
    for m in range(REPEATS):
        g = mix(shingle + np.uint64((0xA0761D6478BD642F * (m + 1)) % 2**64))
        x, y = mix(g ^ np.uint64(0xE7037ED1A0B428DB)), mix(g ^ np.uint64(0x8EBC6AF09C88C6E3))
        r = -np.log(_uniform(x, 0) * _uniform(x, 1))
        c = -np.log(_uniform(x, 2) * _uniform(y, 0))
        beta = _uniform(y, 1)
        level = np.floor(log_w / r + beta)
        rank = np.log(c) - r * (level - beta + 1)
        cell = of * BINS + (g % np.uint64(BINS)).astype(np.int64)
        least = np.full(n * BINS, np.inf)
        np.minimum.at(least, cell, rank)
        won = rank == least[cell]
        own = out[:, m].reshape(-1)
        own[cell[won]] = mix(shingle[won] + level[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        own = own.reshape(n, BINS)
        holes = np.flatnonzero((own == 0).any(1) & (own != 0).any(1))
        if len(holes):
            part = own[holes]
            filled = part.copy()
            for d in range(1, BINS):
                source = np.roll(part, -d, 1)
                take = (filled == 0) & (source != 0)
                filled[take] = mix(source[take] + np.uint64(d)) | np.uint64(1)
            own[holes] = filled
        out[:, m] = own
    return out.reshape(n, REPEATS * BINS)


def bands(sample: np.ndarray) -> np.ndarray:
    n = len(sample)
    by = sample.reshape(n, -1, ROWS)
    key = np.arange(by.shape[1], dtype=np.uint64)[None].repeat(n, 0)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + by[:, :, k])
    return key.astype(np.int64)


def _signatures(own: DataFrame, idf: Broadcast) -> DataFrame:
    """The columns of ``own`` but the text, c1 and c2 (content), weight (of all shingles), bands (null for texts without words)."""
    kept = [c for c in own.columns if c != "text"]
    own_at = {c: k for k, c in enumerate(own.columns)}
    at_text = own_at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = views(batch.column(at_text))
            parts = []
            for i, j in row_groups(at):
                of, shingle, tf, c1, c2 = features(data[at[i] : at[j]], at[i : j + 1])
                weight = weights(shingle, tf, idf.value)
                key = bands(samples(of, shingle, weight, j - i))
                parts.append((c1, c2, np.bincount(of, weight, j - i), key, np.bincount(of, minlength=j - i) > 0))
            if parts:
                c1, c2, total, key, some = (np.concatenate(x) for x in zip(*parts))
                size = np.concatenate([[0], np.cumsum(np.full(len(key), key.shape[1]))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(size), pa.array(key.reshape(-1)), mask=pa.array(~some))
                yield pa.RecordBatch.from_pydict({c: batch.column(own_at[c]) for c in kept} | {"c1": pa.array(c1.astype(np.int64)), "c2": pa.array(c2.astype(np.int64)), "weight": pa.array(total.astype(np.float64)), "bands": lists})

    return batched(own, run, ", ".join(f"{c} long" for c in kept) + ", c1 long, c2 long, weight double, bands array<long>")


def _similarities(pairs: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """a, b and the weighted Jaccard similarity of their texts (node, text)."""

    def with_text(rows: DataFrame, side: str, other: str) -> DataFrame:
        many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))  # a pivot has as many pairs as its buckets have members
        return salted_join(rows, texts.select(F.col("node").alias(side), F.col("text").alias("text_" + side)), [side], "n", F.col(other), counts=many)

    two = with_text(with_text(pairs, "b", "a"), "a", "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [views(batch.column(k)) for k in (2, 3)]
            out = []
            for i, j in row_groups(sides[0][0] + sides[1][0]):
                got = []
                for at, data in sides:
                    of, shingle, tf, _, _ = features(data[at[i] : at[j]], at[i : j + 1])
                    got.append((of, shingle, weights(shingle, tf, idf.value)))
                of, shingle, weight = (np.concatenate(x) for x in zip(*got))
                order = np.lexsort((shingle, of))
                of, shingle, weight = of[order], shingle[order], weight[order]
                same = np.flatnonzero((of[1:] == of[:-1]) & (shingle[1:] == shingle[:-1]))
                both = np.bincount(of[same], np.minimum(weight[same], weight[same + 1]), j - i)
                either = np.bincount(of, weight, j - i) - both
                out.append(both / np.maximum(either, 1e-300))
            if out:
                yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "similarity": pa.array(np.concatenate(out))})

    return batched(two, run, "a long, b long, similarity double")


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node of the component of each."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return node, node[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up


def components(edges: DataFrame, paths: list[str], n: int | None = None) -> DataFrame:
    """node and comp, its component's least node, for every node of ``edges`` (a, b), of which there are ``n``.

    Up to ``EDGES`` edges one task solves, in one query; more of them, or an unknown number, take
    least labels of neighbours, with pointer jumping, in several queries a round.
    """
    if n is not None and n <= EDGES:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
            if ends:
                node, comp = least_nodes(*np.concatenate(ends, 1))
                yield pa.RecordBatch.from_pydict({"node": pa.array(node), "comp": pa.array(comp)})

        return cut(edges.select("a", "b").coalesce(1).mapInArrow(solve, "node long, comp long"), paths)
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), paths)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), paths)
    while True:
        of_b = labels.select(F.col("node").alias("b"), "comp")
        near = both.join(of_b, "b").groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via", "left")
        new = cut(jump.select("node", "old", F.least("via", F.coalesce("far", "via")).alias("comp")), paths)
        if new.filter("old <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """k and h, 128 bits of a row's doc_id and text."""
    h = F.xxhash64(text.cast("binary"))
    return [F.xxhash64(doc_id, h).alias("k"), h.alias("h")]


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = grouped(own.filter("doc_id IS NOT NULL"), threshold).select("doc_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return found.unionByName(own.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def grouped(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k and h (``row_key``), group (null for a text without words) and class_id, the group's least doc_id, of every row, those of null doc_id too."""
    spark: SparkSession = docs.sparkSession
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    own = docs.select(doc.alias("doc_id"), *row_key(doc, text), text.cast("binary").alias("text"))
    paths: list[str] = []
    idf = spark.sparkContext.broadcast(inverse_frequencies(document_frequencies(own)))  # SKETCHES * BUCKETS floats, 6 MB
    signed = cut(_signatures(own, idf), paths)
    with_words = signed.filter("bands IS NOT NULL")
    merged = with_words.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.min(F.struct("k", "h")).alias("row"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    contents = cut(merged.withColumn("node", F.monotonically_increasing_id()), paths)  # written, so that each text keeps its number

    keyed = contents.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = cut(keyed.join(shared, "key"), paths)
    involved = cut(contents.join(met.select("node").distinct(), "node", "left_semi").select("node", "row.k", "row.h", "weight", "bands"), paths)
    rows = own.groupBy("k", "h").agg(F.first("text").alias("text"))  # of repeated rows one, in each task before they are shuffled
    texts = cut(rows.join(involved.select("node", "k", "h"), ["k", "h"]).select("node", "text"), paths)
    able, partners = _able(texts, involved, idf, threshold, paths)
    members = met.join(able, "node")
    first = members.groupBy("key").agg(F.min(F.struct("lone", "node")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(members.join(first.select("key", F.col("least.node").alias("least")), "key"), paths)

    possible = lambda own, other: _possible(own, other, threshold)
    second = lambda node: able.select(F.col("node").alias(node), F.col("weight").alias("w"), F.col("lone").alias("l"), F.col("rare").alias("r"))
    leading = members.filter("node <> least").join(second("least"), "least").filter(possible("rare", "r")).select(F.least("least", "node").alias("a"), F.greatest("least", "node").alias("b"))
    paired = partners.join(able.withColumnRenamed("node", "a").drop("bands"), "a").join(second("b"), "b").filter(possible("lone", "l")).select("a", "b")
    pairs = leading.unionByName(paired).distinct()
    comp = contents.select("node", F.col("node").alias("comp")).limit(0)
    tested: list[str] = []
    chosen: list[str] = []
    used = members.filter("node = least").select("key", "node")
    turn = 0
    while True:
        if tested:
            pairs = pairs.join(spark.read.schema(pairs.schema).parquet(*tested), ["a", "b"], "left_anti")
        pairs = cut(pairs, paths)
        tested.append(paths[-1])
        scored = cut(_similarities(pairs, texts, idf), paths)
        comp = _joined(comp, scored.filter(F.col("similarity") >= threshold).select("a", "b"), paths)

        placed = members.select("key", "node", "lone", "rare", "weight", "bands").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("comps"))
        open_ = cut(placed.join(sizes.filter("comps > 1").select("key", "main"), "key"), paths)
        earlier = used.unionByName(spark.read.schema(used.schema).parquet(*chosen)) if chosen else used
        fresh = open_.join(earlier, ["key", "node"], "left_anti")
        take = HUBS if turn == 0 else PIVOTS << min(turn, 20)
        pivots = cut(_few(fresh if turn == 0 else fresh.filter("comp <> main"), take), paths)
        chosen.append(paths[-1])
        if pivots.isEmpty():
            break
        pairs = _crossing(pivots, open_, threshold)
        turn += 1

    groups = contents.select("c1", "c2", "n", "least", "node").join(comp, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    named = groups.groupBy("group").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("m"))
    final = salted_join(groups.select("c1", "c2", "n", "group"), named, ["group"], "m", F.col("c1"))
    some = salted_join(with_words.drop("bands", "weight"), final.drop("n"), ["c1", "c2"], "n", F.monotonically_increasing_id(), counts=contents.select("c1", "c2", "n")).select("doc_id", "k", "h", "group", "class_id")
    null = F.lit(None).cast("long")
    none = signed.filter("bands IS NULL").select("doc_id", "k", "h", null.alias("group"), null.alias("class_id"))
    out = cut(some.unionByName(none))
    for path in paths:
        remove(spark, path)
    return out


def _able(texts: DataFrame, involved: DataFrame, idf: Broadcast, threshold: float, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """node, weight and bands (from ``involved``), lone and rare (the shares of the weight in shingles that no other text has, and one other at most), where lone leaves room for the threshold; and (a, b), those that are each other's only ones for some shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = views(batch.column(1))
            node = batch.column(0).to_numpy()
            for i, j in row_groups(at):
                of, shingle, tf, _, _ = features(data[at[i] : at[j]], at[i : j + 1])
                weight = weights(shingle, tf, idf.value)
                total = np.bincount(of, weight, j - i)
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingle.astype(np.int64)), "node": pa.array(node[i:j][of]), "share": pa.array(weight / total[of])})

    rows = batched(texts.select("node", "text"), run, "shingle long, node long, share double")
    ends = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min_by("share", "node").alias("a_share"), F.max_by("share", "node").alias("b_share"), F.count(F.lit(1)).alias("n"))
    few = cut(ends.filter("a = b OR n = 2").drop("shingle", "n"), paths)
    one = few.filter("a = b").select(F.col("a").alias("node"), F.col("a_share").alias("lone"), F.col("a_share").alias("rare"))
    of = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_share").alias("rare")), F.struct(F.col("b").alias("node"), F.col("b_share").alias("rare"))))
    two = few.filter("a <> b").select(of.alias("x")).select("x.node", F.lit(0.0).alias("lone"), "x.rare")
    lone = one.unionByName(two).groupBy("node").agg(F.sum("lone").alias("lone"), F.sum("rare").alias("rare"))

    able = involved.join(lone, "node", "left").select("node", "weight", "bands", F.coalesce("lone", F.lit(0.0)).alias("lone"), F.coalesce("rare", F.lit(0.0)).alias("rare"))
    return cut(able.filter(F.col("lone") <= 1 - threshold + 1e-9), paths), cut(few.filter("a <> b").select("a", "b").distinct(), paths)


def _possible(own: str, other: str, threshold: float) -> Column:
    """What two texts share is at most what either (weight and ``own``, w and ``other``) has beside its own; so is their similarity."""
    both = F.least(F.col("w") * (1 - F.col(other)), F.col("weight") * (1 - F.col(own)))
    return both >= (threshold - 1e-9) * (F.col("w") + F.col("weight") - both)


def _crossing(pivots: DataFrame, open_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pivots with members of their bucket that are in other components, where 0.8 is possible.

    Near copies share many bands; a pair is left to the least of its buckets.  It stays open as
    long as the two are in different components, and one of them becomes a pivot there.
    """
    ends = pivots.select("key", F.col("node").alias("p"), F.col("comp").alias("p_comp"), F.col("weight").alias("w"), F.col("rare").alias("r"), F.col("bands").alias("p_bands"))
    here = F.array_min(F.array_intersect("bands", "p_bands")) == F.col("key")
    crossing = ends.join(open_, "key").filter((F.col("comp") != F.col("p_comp")) & _possible("rare", "r", threshold) & here)
    return crossing.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()


def _joined(comp: DataFrame, links: DataFrame, paths: list[str]) -> DataFrame:
    """``comp`` (node, comp) with the links (a, b) added; what is known is contracted first, so later rounds have few edges."""
    at = lambda side: F.coalesce(F.col(f"{side}_comp"), F.col(side))
    edges = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("b_comp")), "b", "left")
    edges = cut(edges.select(at("a").alias("a"), at("b").alias("b")).filter("a <> b").distinct(), paths)
    n = edges.count()
    if n == 0:
        return comp
    found = components(edges, paths, n)
    moved = comp.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return cut(moved.unionByName(found.join(comp, "node", "left_anti").select("node", "comp")), paths)


def _few(rows: DataFrame, take: int) -> DataFrame:
    """key, node, comp, weight, rare and bands of the first ``take`` rows a key, those of the least weight of their own first.

    The limit on the rank is applied within tasks before rows are shuffled.
    """
    order = W.partitionBy("key").orderBy("lone", F.xxhash64("node"), "node")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= take).select("key", "node", "comp", "weight", "rare", "bands")
