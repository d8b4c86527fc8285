"""Decoding DataFrames of shots: one narrow stage of Arrow batches over a broadcast graph.

A shots frame has a key and ``hits`` (array of node ids), or a binary or array
column that ``hits_of_*`` turns into one.  Shots are independent, so nothing is
shuffled; a partition's shots share the kernel's memory of searches and solved
components.  The compiled graph is broadcast, after a check of its size: about
200 bytes an edge, ``MOST_EDGES`` edges at most.  A larger graph is decoded by
``decode_by_component``, which brings each connected component's edges together
with the hits in it instead.

Infeasible shots raise by default, as a library call would; ``on_error="null"``
gives them null results and a status instead, so one shot doesn't stop a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.compiled import Compiled, NoMatching
from ..core.graph import Matching
from ..functions.bits import set_bits

MOST_EDGES = 5_000_000
OUTPUTS = {"mask": "mask long", "prediction": "prediction array<int>", "packed": "packed binary", "weight": "weight double", "weight_int": "weight_int long", "pairs": "pairs array<struct<node1:long,node2:long>>", "edges": "edges array<struct<node1:long,node2:long>>"}
_PAIR = pa.list_(pa.struct([("node1", pa.int64()), ("node2", pa.int64())]))
_ARROW = {"mask": pa.int64(), "prediction": pa.list_(pa.int32()), "packed": pa.binary(), "weight": pa.float64(), "weight_int": pa.int64(), "pairs": _PAIR, "edges": _PAIR}


def hits_of_dense(bits: Column, num_detectors: int, num_nodes: int) -> Column:
    """Places of the ones of an array of 0 and 1, which must cover the detectors and may cover boundary nodes."""
    wrong = F.raise_error(F.concat(F.lit("a syndrome's length doesn't fit this graph: "), F.size(bits).cast("string")))
    at = F.filter(F.transform(bits, lambda x, i: F.when(x != 0, i.cast("long"))), lambda x: x.isNotNull())
    return F.when(F.size(bits).between(num_detectors, num_nodes), at).otherwise(wrong.cast("array<long>"))


def hits_of_packed(packed: Column, num_detectors: int, num_nodes: int) -> Column:
    """Places of the set bits of a binary, little-endian."""
    size = F.length(packed)
    wrong = F.raise_error(F.concat(F.lit("a packed shot's length doesn't fit this graph: "), size.cast("string")))
    return F.when(size.between((num_detectors + 7) // 8, (num_nodes + 7) // 8), F.transform(set_bits(packed), lambda x: x.cast("long"))).otherwise(wrong.cast("array<long>"))


def hits_of_differences(rows: DataFrame, checks: int, key: str = "shot") -> DataFrame:
    """(key, hits) of rows (key, check_id, t, bit): the node of a set bit is t * checks + check_id."""
    return rows.filter("bit = 1").groupBy(key).agg(F.sort_array(F.collect_list((F.col("t") * checks + F.col("check_id")).cast("long"))).alias("hits"))


def difference_syndrome(measured: DataFrame, key: str = "shot") -> DataFrame:
    """(key, check_id, t, bit) of measured rows: each check XOR the one at t - 1, 0 before the first."""
    before = measured.select(key, "check_id", (F.col("t") + 1).alias("t"), F.col("bit").alias("b"))
    return measured.join(before, [key, "check_id", "t"], "left").select(key, "check_id", "t", F.col("bit").bitwiseXOR(F.coalesce("b", F.lit(0))).cast("int").alias("bit"))


def _solver(own: Compiled, outputs: tuple[str, ...], correlated: bool):
    n = own.num_faults

    def of(hits: list[int]) -> list:
        graph = own.reweighted(own.decode_edges(hits)) if correlated else own
        if "pairs" in outputs and own.negative_sum:
            raise ValueError("matched pairs aren't defined for a graph with negative edge weights")
        weight, mask, pairs = graph.match(graph.hits(hits))
        mask ^= graph.negative_mask
        weight += graph.negative_sum
        out = []
        for what in outputs:
            if what == "mask":
                if n > 64:
                    raise ValueError("a mask holds 64 fault ids; ask for prediction or packed instead")
                out.append(mask - (1 << 64) if mask >> 63 else mask)
            elif what == "prediction":
                out.append([mask >> i & 1 for i in range(n)])
            elif what == "packed":
                out.append(mask.to_bytes((n + 7) // 8, "little"))
            elif what == "weight":
                out.append(weight / graph.scale)
            elif what == "weight_int":
                out.append(weight)
            elif what == "pairs":
                out.append([{"node1": u, "node2": v} for u, v in sorted(pairs)])
            else:
                chosen = set(graph.negative)
                for u, v in pairs:
                    chosen ^= set(graph.path(u, v))
                out.append([{"node1": u, "node2": v} for u, v in sorted(chosen)])
        return out

    return of


def decode(shots: DataFrame, graph: Matching, outputs: tuple[str, ...] = ("mask", "weight"), keys: tuple[str, ...] | None = None, hits: str = "hits", enable_correlations: bool = False, on_error: str = "raise") -> DataFrame:
    """The key columns of ``shots`` (all but the hits by default) and the outputs asked for; only those are computed."""
    own = graph._checked(enable_correlations)
    if len(own.signed) > MOST_EDGES:
        raise ValueError(f"a graph of {len(own.signed)} edges is too large to be broadcast; use decode_by_component")
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    keys = tuple(c for c in shots.columns if c != hits) if keys is None else keys
    shared = shots.sparkSession.sparkContext.broadcast(own)
    quiet = on_error == "null"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = _solver(shared.value, tuple(outputs), enable_correlations)
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in outputs]
            status: list[str] = []
            raw = batch.column(len(keys))
            flat, at = raw.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(raw.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            for a, b in zip(at, at[1:]):
                one = tuple(flat[a:b])
                found = seen.get(one)
                if found is None:
                    try:
                        found = (solve(list(one)), "ok")
                    except NoMatching as e:
                        if not quiet:
                            raise
                        found = ([None] * len(outputs), str(e))
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[one] = found
                for values, v in zip(columns, found[0]):
                    values.append(v)
                status.append(found[1])
            arrays = [*(batch.column(i) for i in range(len(keys))), *(pa.array(v, _ARROW[o]) for v, o in zip(columns, outputs)), *([pa.array(status)] if quiet else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *outputs, *(["status"] if quiet else [])])

    kinds = [f"`{k}` {shots.schema[k].dataType.simpleString()}" for k in keys] + [OUTPUTS[o] for o in outputs] + ["status string"] * quiet
    return shots.select(*keys, F.coalesce(F.col(hits), F.expr("CAST(array() AS array<long>)")).cast("array<long>").alias(hits)).mapInArrow(run, ", ".join(kinds))


def decode_by_component(shots: DataFrame, edges: DataFrame, component_of: DataFrame, norm: float, key: str = "shot", block: int = 5_000) -> DataFrame:
    """(key, mask, weight_int) over a graph that isn't broadcast.

    ``edges`` (node1, node2 or null, weight, fault_ids) carry their component in
    ``component_of`` (node, comp).  Hits are dealt to components; of a component's
    shots about ``block`` at a time meet its edges in a task, however many shots it
    has, so one task holds one component's edges and solves shots as they
    stream by; a shot's parts are added up.  Boundary nodes must have been collapsed, and
    weights must be non-negative; ``norm`` is the whole graph's.
    """
    kind = shots.schema[key].dataType.simpleString()
    hit = shots.select(F.col(key).alias("shot"), F.explode("hits").alias("node")).join(component_of.select("node", F.col("comp").alias("part")), "node")
    parts = hit.groupBy("part", "shot").agg(F.sort_array(F.collect_list("node")).alias("hits"))
    blocks = parts.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = parts.join(blocks, "part").select("part", F.pmod(F.xxhash64("shot"), F.col("blocks")).alias("block"), F.lit(1).alias("what"), "shot", "hits", *(F.lit(None).cast(t).alias(c) for c, t in _EDGE.items()))
    place = component_of.select(F.col("node").alias("node1"), F.col("comp").alias("part"))
    own = edges.select("node1", F.col("node2").cast("long").alias("node2"), F.col("weight").cast("double").alias("weight"), F.col("fault_ids").cast("array<long>").alias("fault_ids")).join(place, "node1").join(blocks, "part")
    copied = own.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("what"), F.lit(None).cast(kind).alias("shot"), F.lit(None).cast("array<long>").alias("hits"), *_EDGE)
    met = copied.unionByName(dealt).repartition("part", "block").sortWithinPartitions("part", "block", "what")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, solver, names = None, [], None, {}
        for batch in batches:
            keys, found = [], []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            shot = columns[3]
            for i, (part, block_, what, hits) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[4].to_pylist())):
                if (part, block_) != now:
                    now, rows, solver, names = (part, block_), [], None, {}
                at = lambda x: names.setdefault(x, len(names))  # noqa: E731, B023
                if what == 0:
                    u, v, w, faults = (columns[k][i].as_py() for k in range(5, 9))
                    rows.append((at(u), None if v is None else at(v), faults or [], round(w * norm)))
                    continue
                if solver is None:
                    solver = Compiled(len(names), rows)
                    rows = []
                keys.append(i)
                found.append(solver.decode([names[x] for x in hits]))
            if keys:
                yield pa.RecordBatch.from_arrays([shot.take(pa.array(keys)), pa.array([m for m, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64())], names=["shot", "mask", "weight_int"])

    solved = met.mapInArrow(run, f"shot {kind}, mask long, weight_int long")
    total = solved.groupBy(F.col("shot").alias(key)).agg(F.bit_xor("mask").alias("mask"), F.sum("weight_int").alias("weight_int"))
    return shots.select(key).join(total, key, "left").select(key, F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.coalesce("weight_int", F.lit(0).cast("long")).alias("weight_int"))


_EDGE = {"node1": "long", "node2": "long", "weight": "double", "fault_ids": "array<long>"}


def matched_dict(decoded: DataFrame, pairs: str = "pairs") -> DataFrame:
    """``pairs`` as a map in both directions, null for the boundary."""
    mate = lambda p: F.struct(p["node1"].alias("key"), F.when(p["node2"] >= 0, p["node2"]).alias("value"))
    back = F.transform(F.filter(pairs, lambda p: p["node2"] >= 0), lambda p: F.struct(p["node2"].alias("key"), p["node1"].alias("value")))
    return decoded.withColumn("mates", F.map_from_entries(F.concat(F.transform(pairs, mate), back)))


def small_shots(shots: DataFrame, distance: DataFrame, away: DataFrame, key: str = "shot") -> DataFrame:
    """(key, weight) of shots of few hits by relational operators alone: subset sums level by level.

    ``distance`` is (src, dst, d), ``away`` (node, b).  A state is the set of open
    hits as bits; each level matches the lowest open hit with another one or with
    the boundary and keeps the least total of each (shot, state), so a shot has
    at most 2^hits states, however many orders there are, and the largest shot has as
    many levels as hits.  Infeasible shots have null; bits are those of a LONG, so shots of 64 and more raise.
    """
    most_hits = shots.agg(F.max(F.size("hits")).alias("n")).first().n or 0
    if most_hits > 62:
        raise ValueError(f"a shot of {most_hits} hits has more states than this can hold; use decode")
    hit = shots.select(key, F.posexplode("hits").alias("i", "node"))
    other = hit.select(key, F.col("i").alias("j"), F.col("node").alias("to"))
    pair = hit.join(other, key).filter("i < j").join(distance.select(F.col("src").alias("node"), F.col("dst").alias("to"), "d"), ["node", "to"])
    alone = hit.join(away, "node").select(key, "i", F.col("i").alias("j"), F.col("b").alias("cost"))
    moves = pair.select(key, "i", "j", F.col("d").alias("cost")).unionByName(alone)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    moves = moves.select(key, "i", bit("i").bitwiseOR(bit("j")).alias("takes"), "cost")
    state = shots.select(key, (F.call_function("shiftleft", F.lit(1).cast("long"), F.size("hits")) - 1).alias("open"), F.lit(0).cast("long").alias("total"))
    for _ in range(most_hits):
        # done states (no lowest hit) and stuck ones find no move and stay
        low = F.when(F.col("open") != 0, F.round(F.log2(F.col("open").bitwiseAND(-F.col("open")))).cast("int"))
        at = state.select(F.col(key).alias("k"), "open", "total", low.alias("low"))
        step = at.join(moves, (F.col("k") == F.col(key)) & (F.col("low") == F.col("i")) & (F.col("open").bitwiseAND(F.col("takes")) == F.col("takes")), "left")
        left = F.col("open").bitwiseXOR(F.coalesce("takes", F.lit(0)))
        state = step.select(F.col("k").alias(key), left.alias("open"), (F.col("total") + F.coalesce("cost", F.lit(0))).alias("total")).groupBy(key, "open").agg(F.min("total").alias("total"))
    return shots.select(key).join(state.filter("open = 0").select(key, F.col("total").alias("weight")), key, "left")
