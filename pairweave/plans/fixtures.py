"""Matching problems made from the test tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.graph import Matching
from ..operators.merge import merge

NODES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def torus(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """seq, node1, node2, weight, error_probability, fault_ids: the nations as a 5 x 5 torus with some boundary edges.

    Weights are small numbers times 2^21, with an irregular lower part of 21
    bits an edge: every shot has one optimum, so its labels and edges can be compared.
    """
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    null = F.lit(None).cast("long")
    ring = n.select(F.col("n").alias("seq"), F.col("n").alias("node1"), ((F.col("n") + 1) % NODES).alias("node2"), (2 + (7 * F.col("n")) % 5).alias("weight"))
    cross = n.select((F.col("n") + 25).alias("seq"), F.col("n").alias("node1"), ((F.col("n") + 5) % NODES).alias("node2"), (3 + (3 * F.col("n")) % 4).alias("weight"))
    out = n.filter("n % 5 = 0").select((F.col("n") / 5 + 50).cast("long").alias("seq"), F.col("n").alias("node1"), null.alias("node2"), (4 + F.col("n") % 3).alias("weight"))
    edges = ring.unionByName(cross).unionByName(out)
    edges = edges.withColumn("weight", F.col("weight") * (1 << 21) + _irregular(F.col("seq")) % 2_097_143)
    if signed:
        edges = edges.withColumn("weight", F.when(F.col("node1") % 6 == 0, -F.col("weight")).otherwise(F.col("weight")))
    p = (1 + F.col("seq") % 9) / 100.0
    return edges.withColumns({"error_probability": p.cast("double"), "fault_ids": F.array(F.col("node1") % 8)})


def _irregular(x):
    return (x * x * 7919 + x * 104_729 + 12_345) * 48_271


def torus_graph(spark: SparkSession, sf_dir: str, signed: bool = False) -> Matching:
    """The torus as a graph: 55 edges, whatever the scale of the tables."""
    g = Matching()
    for r in torus(spark, sf_dir, signed).orderBy("seq").collect():
        if r.node2 is None:
            g.add_boundary_edge(r.node1, set(r.fault_ids), r.weight, r.error_probability)
        else:
            g.add_edge(r.node1, r.node2, set(r.fault_ids), r.weight, r.error_probability)
    return g


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node1, node2 (null: boundary), weight: an edge between any two nations and to the boundary, all from 2^23 to 2^24.

    Two edges weigh more than any one, so the cheapest way is the edge itself and
    doesn't lead over other hits: here the pairs of an optimum are unique, too.  Sums of
    edges may tie, though: 5 of 39,601 shots at sf0.1 have two optima, none at sf0.01.
    """
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node1"))
    every = n.select("node1", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(NODES).cast("long"))).alias("to")).filter("to > node1")
    return every.select("node1", F.when(F.col("to") < NODES, F.col("to")).alias("node2"), (8_388_608 + _irregular(F.col("node1") * 31 + F.col("to")) % 8_388_593).alias("weight"))


def complete_graph(spark: SparkSession, sf_dir: str) -> Matching:
    """325 edges, whatever the scale of the tables."""
    g = Matching()
    for r in complete(spark, sf_dir).orderBy("node1", "node2").collect():
        g.add_boundary_edge(r.node1, None, r.weight) if r.node2 is None else g.add_edge(r.node1, r.node2, None, r.weight)
    return g


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, hits: a user's events of a day, as nodes, those of an even count cancelled."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), ((F.col("event_id") * 11) % NODES).alias("hit"))
    odd = e.groupBy("user_id", "day", "hit").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return odd.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("hit")).alias("hits"))


def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, node1, node2, weight, error_probability, fault_ids: a row a line item, between its supplier's and its customer's nations.

    seq is text that sorts as the line item's nine columns do: an order of all rows without a rank over them.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("node2"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("node1"))
    digits = lambda x, n: F.lpad(x.cast("long").cast("string"), n, F.lit("0"))
    cents = lambda x: F.round(F.col(x) * 100)
    seq = F.concat_ws("-", *(digits(F.col(x), 12) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), digits(cents("l_quantity"), 8), digits(cents("l_extendedprice"), 12), F.date_format("l_shipdate", "yyyyMMdd"), digits(cents("l_discount"), 3), digits(cents("l_tax"), 3))
    fault = (F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey")) % 8
    rows = li.select("l_orderkey", "l_suppkey", cents("l_discount").cast("long").alias("d"), F.col("l_quantity").alias("q"), seq.alias("seq"), fault.cast("long").alias("fault"))
    both = rows.join(o, rows.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    p = F.lit(0.01) + F.col("d") / 1000.0
    return both.select("seq", "node1", "node2", (F.col("q") + F.col("d") / 16.0).cast("double").alias("weight"), p.cast("double").alias("error_probability"), F.array("fault").alias("fault_ids"))


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that grows with the tables: suppliers and customers (from a million on) as nodes, a line item a parallel edge, one in forty to the boundary; of parallel ones the least stays."""
    p = parallel(spark, sf_dir)
    part = F.split("seq", "-")
    li = p.select("seq", part[2].cast("long").alias("partkey"), part[3].cast("long").alias("node1"), part[0].cast("long").alias("o_orderkey"), F.col("weight"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = li.join(o, "o_orderkey")
    rows = both.select("seq", "node1", F.when(F.col("partkey") % 40 != 0, 1_000_000 + F.col("o_custkey")).cast("long").alias("node2"), (F.col("weight") - 20).alias("weight"), F.lit(None).cast("double").alias("error_probability"), F.array(F.col("partkey") % 32).alias("fault_ids"))
    return merge(rows, "smallest-weight")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """err, p, component, edge, node1, node2: all pairs of torus edges of equal seq % 5 as decomposed errors."""
    t = torus(spark, sf_dir).select("seq", "node1", "node2")
    a, b = t.withColumnsRenamed({c: "a_" + c for c in t.columns}), t.withColumnsRenamed({c: "b_" + c for c in t.columns})
    pair = a.join(b, (F.col("a_seq") % 5 == F.col("b_seq") % 5) & (F.col("a_seq") < F.col("b_seq")))
    err = pair.withColumn("err", F.col("a_seq") * 100 + F.col("b_seq")).withColumn("p", (1 + F.col("err") % 10) / 1000.0 + (_irregular(F.col("err")) % 1_000_003) / 1e10)
    one = F.explode(F.array(F.struct(F.lit(0).alias("component"), F.col("a_seq").alias("edge"), F.col("a_node1").alias("node1"), F.col("a_node2").alias("node2")), F.struct(F.lit(1).alias("component"), F.col("b_seq").alias("edge"), F.col("b_node1").alias("node1"), F.col("b_node2").alias("node2"))))
    return err.select("err", F.col("p").cast("double").alias("p"), one.alias("x")).select("err", "p", "x.*")


SQL_TORUS = """
torus0 AS (
  SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_nationkey AS BIGINT) AS node1, CAST((n_nationkey + 1) % 25 AS BIGINT) AS node2, CAST(2 + (7 * n_nationkey) % 5 AS BIGINT) AS base FROM nation
  UNION ALL SELECT n_nationkey + 25, n_nationkey, (n_nationkey + 5) % 25, 3 + (3 * n_nationkey) % 4 FROM nation
  UNION ALL SELECT n_nationkey // 5 + 50, n_nationkey, NULL, 4 + n_nationkey % 3 FROM nation WHERE n_nationkey % 5 = 0),
torus AS (
  SELECT seq, node1, node2, CAST(base * 2097152 + ((seq * seq * 7919 + seq * 104729 + 12345) * 48271) % 2097143 AS BIGINT) AS weight,
         CAST((1 + seq % 9) / 100.0 AS DOUBLE) AS error_probability, node1 % 8 AS fault FROM torus0),
signed_torus AS (SELECT * REPLACE (CASE WHEN node1 % 6 = 0 THEN -weight ELSE weight END AS weight) FROM torus)"""

SQL_COMPLETE = """
complete AS (SELECT CAST(n_nationkey AS BIGINT) AS node1, b AS node2, CAST(8388608 + (((n_nationkey * 31 + b) * (n_nationkey * 31 + b) * 7919 + (n_nationkey * 31 + b) * 104729 + 12345) * 48271) % 8388593 AS BIGINT) AS weight
  FROM nation, range(1, 26) AS r(b) WHERE b > n_nationkey),
distance AS (SELECT node1 AS src, node2 AS dst, weight AS d, CAST(0 AS BIGINT) AS m FROM complete WHERE node2 < 25),
away AS (SELECT node1 AS node, weight AS b, CAST(0 AS BIGINT) AS m FROM complete WHERE node2 = 25)"""

SQL_SHOTS = """
odd AS (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, (event_id * 11) % 25 AS hit FROM events
  GROUP BY ALL HAVING count(*) % 2 = 1),
shots AS (SELECT user_id, day, list_sort(list(hit)) AS hits FROM odd GROUP BY ALL)"""

_DIGITS = "lpad(CAST(CAST({} AS BIGINT) AS VARCHAR), {}, '0')"
SQL_PARALLEL = f"""
parallel AS (
  SELECT concat_ws('-', {", ".join(_DIGITS.format(x, 12) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))}, {_DIGITS.format("round(l_quantity * 100)", 8)}, {_DIGITS.format("round(l_extendedprice * 100)", 12)},
                   strftime(l_shipdate, '%Y%m%d'), {_DIGITS.format("round(l_discount * 100)", 3)}, {_DIGITS.format("round(l_tax * 100)", 3)}) AS seq,
         CAST((l_orderkey * 7 + l_linenumber + l_partkey) % 8 AS BIGINT) AS fault,
         CAST(s_nationkey AS BIGINT) AS node1, CAST(c_nationkey AS BIGINT) AS node2,
         l_quantity + CAST(round(l_discount * 100) AS BIGINT) / 16.0 AS weight,
         CAST(0.01 AS DOUBLE) + CAST(round(l_discount * 100) AS BIGINT) / CAST(1000.0 AS DOUBLE) AS error_probability
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

SQL_LARGE = """
large0 AS (
  SELECT p.seq, CAST(string_split(p.seq, '-')[4] AS BIGINT) AS node1, CASE WHEN CAST(string_split(p.seq, '-')[3] AS BIGINT) % 40 <> 0 THEN CAST(1000000 + o_custkey AS BIGINT) END AS node2,
         p.weight - 20 AS weight, CAST(string_split(p.seq, '-')[3] AS BIGINT) % 32 AS fault
  FROM parallel p JOIN orders ON o_orderkey = CAST(string_split(p.seq, '-')[1] AS BIGINT)),
large AS (
  SELECT min(seq) AS seq, node1, node2, arg_min(weight, (weight, seq)) AS weight, arg_min(fault, (weight, seq)) AS fault FROM (SELECT *, coalesce(node2, -1) AS k2 FROM large0) GROUP BY node1, node2, k2)"""

SQL_ERRORS = """
pairs AS (
  SELECT a.seq * 100 + b.seq AS err, a.seq AS aseq, a.node1 AS a1, a.node2 AS a2, b.seq AS bseq, b.node1 AS b1, b.node2 AS b2
  FROM torus a JOIN torus b ON a.seq % 5 = b.seq % 5 AND a.seq < b.seq),
chances AS (
  SELECT *, (1 + err % 10) / CAST(1000.0 AS DOUBLE) + (((err * err * 7919 + err * 104729 + 12345) * 48271) % 1000003) / CAST(1e10 AS DOUBLE) AS p FROM pairs),
errors AS (
  SELECT err, p, 0 AS component, aseq AS edge, a1 AS node1, a2 AS node2 FROM chances
  UNION ALL SELECT err, p, 1, bseq, b1, b2 FROM chances)"""

#: Cheapest distances over absolute weights by lengthening paths, with the path's edges as bits; the torus needs 16 steps at most.
_TWICE = "SELECT a.src, b.dst, min(a.d + b.d) AS d, arg_min(xor(a.m, b.m), a.d + b.d) AS m FROM {0} a JOIN {0} b ON a.dst = b.src GROUP BY ALL"
SQL_DISTANCES = f"""
step AS (
  SELECT node1 AS src, node2 AS dst, abs(weight) AS d, CAST(1 AS BIGINT) << CAST(seq AS INT) AS m FROM {{graph}} WHERE node2 IS NOT NULL
  UNION ALL SELECT node2, node1, abs(weight), CAST(1 AS BIGINT) << CAST(seq AS INT) FROM {{graph}} WHERE node2 IS NOT NULL),
d1 AS (SELECT src, dst, min(d) AS d, arg_min(m, d) AS m FROM (SELECT * FROM step UNION ALL SELECT n_nationkey, n_nationkey, 0, 0 FROM nation) GROUP BY ALL),
d2 AS ({_TWICE.format("d1")}), d4 AS ({_TWICE.format("d2")}), d8 AS ({_TWICE.format("d4")}),
distance AS ({_TWICE.format("d8")}),
away AS (SELECT src AS node, min(d + abs(weight)) AS b, arg_min(xor(m, CAST(1 AS BIGINT) << CAST(seq AS INT)), d + abs(weight)) AS m FROM distance JOIN {{graph}} ON dst = node1 AND node2 IS NULL GROUP BY ALL)"""

#: Subset sums: the lowest open hit goes with another one or with the boundary; totals, edges (bits) and pairs of the least.
SQL_MATCH = """
hit AS (SELECT {key}, i - 1 AS i, {hits}[i] AS node FROM {shots}, unnest(range(1, len({hits}) + 1)) AS u(i)),
moves AS (
  SELECT {a_key}, a.i, (1 << CAST(a.i AS INT)) | (1 << CAST(b.i AS INT)) AS takes, d AS cost, m, a.node || ':' || b.node || ' ' AS pair
  FROM hit a JOIN hit b ON {same_ab} AND a.i < b.i JOIN {distance} ON src = a.node AND dst = b.node{and_distance}
  UNION ALL SELECT {a_key}, a.i, 1 << CAST(a.i AS INT), b, m, a.node || ':-1 ' FROM hit a JOIN {away} w ON w.node = a.node{and_away}),
state AS (
  SELECT {key}, (1 << CAST(len({hits}) AS INT)) - 1 AS open, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS m, '' AS pairs FROM {shots}
  UNION ALL
  SELECT {s_key}, xor(s.open, m.takes), min(s.total + m.cost), arg_min(xor(s.m, m.m), s.total + m.cost), arg_min(s.pairs || m.pair, s.total + m.cost)
  FROM state s JOIN moves m ON {same_sm} AND (s.open & ((1 << CAST(m.i AS INT)) - 1)) = 0 AND (s.open & m.takes) = m.takes
  GROUP BY ALL),
solved AS (SELECT {key}, min(total) AS weight, arg_min(m, total) AS m, trim(arg_min(pairs, total)) AS pairs FROM state WHERE open = 0 GROUP BY ALL)"""


def sql_match(shots: str, key: tuple[str, ...] = ("user_id", "day"), hits: str = "hits", distance: str = "distance", away: str = "away", own_ways: bool = False) -> str:
    """``solved`` (key, weight, m, pairs) of a relation of shots; with ``own_ways`` distances have the key, too."""
    of = lambda t: ", ".join(f"{t}.{k}" for k in key)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key)
    return SQL_MATCH.format(
        key=", ".join(key), a_key=of("a"), s_key=of("s"), same_ab=same("a", "b"), same_sm=same("s", "m"), shots=shots, hits=hits, distance=distance, away=away,
        and_distance=" AND " + same("a", distance) if own_ways else "", and_away=" AND " + same("a", "w") if own_ways else "",
    )


#: Labels (bits) and edges (text) of the solutions m of ``solved``.
SQL_LABELS = """
labels AS (SELECT user_id, day, bit_xor(CAST(1 AS BIGINT) << CAST(fault AS INT)) AS mask, string_agg(a || ':' || b, ' ' ORDER BY a, b) AS edges
  FROM {solved} JOIN (SELECT *, least(node1, coalesce(node2, node1)) AS a, CASE WHEN node2 IS NULL THEN -1 ELSE greatest(node1, node2) END AS b FROM {graph}) ON (m >> CAST(seq AS INT)) & 1 = 1 GROUP BY ALL),
answers AS (SELECT user_id, day, weight, pairs, coalesce(mask, 0) AS mask, coalesce(edges, '') AS edges FROM {solved} LEFT JOIN labels USING (user_id, day))"""
