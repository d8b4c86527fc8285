"""Queries of the matching engine and their SQL for DuckDB.

``q_*`` decode, ``g_*`` build and prepare graphs, ``h_*`` read shots, ``x_*``
are distances, ``c_*`` correlations, ``r_*`` sampling, ``e_*`` evaluation,
``p_*`` partitions and ``s_*`` sources and sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.graph import Matching
from ..functions import bits
from ..storage import checkpointed
from ..operators import correlated, evaluate, lookup, merge, partition, paths, prepare, sampling
from ..operators.decode import decode, decode_by_component, difference_syndrome, hits_of_dense, hits_of_differences, hits_of_packed, matched_dict, small_shots
from ..sinks import shots as sinks
from ..sources import check_matrix
from . import fixtures as fx
from .register import QUERIES, SQL, query  # noqa: F401

def _distances(graph: str) -> str:
    return fx.SQL_DISTANCES.format(graph=graph)


_MASK = "CAST(coalesce(bit_xor(CAST(1 << CAST(fault AS INT) AS BIGINT)), 0) AS BIGINT)"
_SOLVED = (fx.SQL_TORUS, fx.SQL_SHOTS, _distances("torus"), fx.sql_match("shots"))
_PAIRED = (fx.SQL_COMPLETE, fx.SQL_SHOTS, fx.sql_match("shots"))
_ANSWERS = (*_SOLVED, fx.SQL_LABELS.format(solved="solved", graph="torus"))


def _text(pairs: str) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["node1"], p["node2"])), " ")


def _keyed(shots: DataFrame) -> DataFrame:
    return shots.withColumn("shot", F.concat_ws("|", "user_id", "day"))


def _unkeyed(found: DataFrame, *columns) -> DataFrame:
    part = F.split("shot", r"\|")
    return found.select(part[0].cast("long").alias("user_id"), part[1].alias("day"), *columns)


# decoding


@query("SELECT user_id, day, CAST(len(hits) AS BIGINT) AS n_hits, weight, mask FROM answers JOIN shots USING (user_id, day)", *_ANSWERS, recursive=True)
def q_decode_weight(spark, sf_dir):
    """The least total weight of every (user, day) shot on the nation torus, and its labels."""
    shots = fx.shots(spark, sf_dir).withColumn("n_hits", F.size("hits").cast("long"))
    return decode(shots, fx.torus_graph(spark, sf_dir), ("weight", "mask")).withColumn("weight", F.col("weight").cast("long"))


_TOGGLED = """negative_ends AS (SELECT node FROM (SELECT node1 AS node FROM signed_torus WHERE weight < 0 UNION ALL SELECT node2 FROM signed_torus WHERE weight < 0 AND node2 IS NOT NULL) GROUP BY node HAVING count(*) % 2 = 1),
mixed AS (SELECT user_id, day, unnest(hits) AS node FROM shots UNION ALL SELECT user_id, day, node FROM shots, negative_ends),
open_hits AS (SELECT user_id, day, node FROM mixed GROUP BY ALL HAVING count(*) % 2 = 1),
toggled AS (SELECT s.user_id, s.day, coalesce(list_sort(list(node) FILTER (node IS NOT NULL)), []) AS hits FROM shots s LEFT JOIN open_hits o ON o.user_id = s.user_id AND o.day = s.day GROUP BY s.user_id, s.day)"""
_SIGNED = """negative AS (SELECT sum(weight) AS w, bit_xor(CAST(1 AS BIGINT) << CAST(seq AS INT)) AS m FROM signed_torus WHERE weight < 0),
signed_solved AS (SELECT user_id, day, CAST(weight + w AS BIGINT) AS weight, pairs, xor(solved.m, negative.m) AS m FROM solved, negative)"""


@query("SELECT user_id, day, weight, mask, edges FROM answers", fx.SQL_TORUS, fx.SQL_SHOTS, _TOGGLED, _distances("signed_torus"), fx.sql_match("toggled"), _SIGNED, fx.SQL_LABELS.format(solved="signed_solved", graph="signed_torus"), recursive=True)
def q_negative(spark, sf_dir):
    """Decoding with negative weights: their sum, and the shot over absolute weights with toggled hits."""
    found = decode(fx.shots(spark, sf_dir), fx.torus_graph(spark, sf_dir, True), ("weight", "mask", "edges"))
    return found.withColumns({"weight": F.col("weight").cast("long"), "edges": _text("edges")})


@query("SELECT user_id, day, weight FROM solved", *_SOLVED, recursive=True)
def q_small_shots(spark, sf_dir):
    """X04 (b): the same optimum by relational operators alone, for shots of few hits."""
    edges = fx.torus(spark, sf_dir)
    table = paths.distances(edges.select("node1", "node2", "weight"), cut=_cut)
    shots = _keyed(fx.shots(spark, sf_dir))
    return _unkeyed(small_shots(shots.select("shot", "hits"), table, paths.boundary_distances(table, edges)), "weight")


def _cut(df: DataFrame) -> DataFrame:
    """A small table that ends its lineage, in the folder that executors share."""
    return checkpointed(df)


@query("SELECT user_id, day, edges FROM answers", *_ANSWERS, recursive=True)
def q_edges(spark, sf_dir):
    """Q06: solution edges."""
    return decode(fx.shots(spark, sf_dir), fx.torus_graph(spark, sf_dir), ("edges",)).withColumn("edges", _text("edges"))


@query("SELECT user_id, day, pairs, CAST(weight AS DOUBLE) AS weight FROM solved", *_PAIRED, recursive=True)
def q_match_pairs(spark, sf_dir):
    """Q07: matched pairs, the boundary being -1, on a graph where they are unique."""
    return decode(fx.shots(spark, sf_dir), fx.complete_graph(spark, sf_dir), ("pairs", "weight")).withColumn("pairs", _text("pairs"))


@query("""SELECT user_id, day, coalesce(string_agg(hit || ':' || coalesce(mate, 'none'), ' ' ORDER BY CAST(hit AS INT)), '') AS mates FROM solved LEFT JOIN both_ways USING (user_id, day) GROUP BY user_id, day""", *_PAIRED,
    """each_pair AS (SELECT user_id, day, unnest(string_split(pairs, ' ')) AS pair FROM solved WHERE pairs <> ''),
ends AS (SELECT user_id, day, split_part(pair, ':', 1) AS a, split_part(pair, ':', 2) AS b FROM each_pair),
both_ways AS (SELECT user_id, day, a AS hit, nullif(b, '-1') AS mate FROM ends UNION ALL SELECT user_id, day, b, a FROM ends WHERE b <> '-1')""", recursive=True)  # fmt: skip
def q_dict(spark, sf_dir):
    """Q08: mates in both directions."""
    found = matched_dict(decode(fx.shots(spark, sf_dir), fx.complete_graph(spark, sf_dir), ("pairs",)))
    each = F.transform(F.array_sort(F.map_keys("mates")), lambda k: F.concat_ws(":", k, F.coalesce(F.element_at("mates", k).cast("string"), F.lit("none"))))
    return found.select("user_id", "day", F.array_join(each, " ").alias("mates"))


@query("SELECT user_id, day, weight * 2 AS weight_int, mask FROM by_four", fx.SQL_TORUS, fx.SQL_SHOTS, _distances("torus"),
    """quarters AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id % 4 AS part, (event_id * 11) % 25 AS hit FROM events GROUP BY ALL HAVING count(*) % 2 = 1),
parts AS (SELECT user_id, day, part, list_sort(list(hit)) AS hits FROM quarters GROUP BY ALL)""", fx.sql_match("parts", ("user_id", "day", "part")),
    """each_part AS (SELECT s.user_id, s.day, s.part, weight, (SELECT coalesce(bit_xor(CAST(1 AS BIGINT) << CAST((fault + s.part) % 8 AS INT)), 0) FROM torus WHERE (s.m >> CAST(seq AS INT)) & 1 = 1) AS mask FROM solved s),
by_four AS (SELECT user_id, day, CAST(sum(weight) AS BIGINT) AS weight, bit_xor(mask) AS mask FROM each_part GROUP BY user_id, day)""", recursive=True)  # fmt: skip
def q_by_component(spark, sf_dir):
    """Q02 without a broadcast graph: hits and edges of four tori brought together by connected component."""
    one = fx.torus(spark, sf_dir).select("node1", "node2", "weight", F.col("fault_ids")[0].alias("fault"), F.explode(F.array(*map(F.lit, range(4)))).alias("part"))
    edges = one.select((F.col("node1") + 25 * F.col("part")).alias("node1"), (F.col("node2") + 25 * F.col("part")).alias("node2"), "weight", F.array((F.col("fault") + F.col("part")) % 8).alias("fault_ids"))
    comp = paths.connected(edges, cut=_cut)
    e = fx.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), ((F.col("event_id") * 11) % 25 + 25 * (F.col("event_id") % 4)).alias("hit"))
    odd = e.groupBy("user_id", "day", "hit").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    shots = _keyed(odd.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("hit")).alias("hits")))
    return _unkeyed(decode_by_component(shots.select("shot", "hits"), edges, comp, 1.0), "weight_int", "mask")


@query("SELECT user_id, day, weight * 2 AS weight_int, mask FROM answers", *_ANSWERS, recursive=True)
def p_decode_in_parts(spark, sf_dir):
    """Shots cut into independent parts, solved apart and added up."""
    return _unkeyed(partition.decode_in_parts(_keyed(fx.shots(spark, sf_dir)).select("shot", "hits"), fx.torus_graph(spark, sf_dir)), "weight_int", "mask")


@query("SELECT user_id, day, weight * 2 AS weight_int, mask FROM answers JOIN shots USING (user_id, day) WHERE len(hits) > 0", *_ANSWERS, recursive=True)
def p_windows(spark, sf_dir):
    """Groups of hits solved in windows of time, fused where they reach over a border, and added up."""
    nodes = partition.partitions(partition.rounds(_nodes(spark, sf_dir)), 2)
    found = partition.decode_windows(_keyed(fx.shots(spark, sf_dir)).select("shot", "hits"), fx.torus_graph(spark, sf_dir), nodes)
    total = found.groupBy("shot").agg(F.sum("weight_int").alias("weight_int"), F.bit_xor("mask").alias("mask"))
    return _unkeyed(total, "weight_int", "mask")


@query("SELECT user_id, day, array_to_string(list_transform(range(0, 8), lambda i: CAST((mask >> CAST(i AS INT)) & 1 AS VARCHAR)), '') AS prediction, upper(format('{:02x}', mask)) AS packed, mask FROM answers", *_ANSWERS, recursive=True)
def q_outputs(spark, sf_dir):
    """Q04, Q09-Q11: labels as a mask, as bits and as packed bytes."""
    found = decode(fx.shots(spark, sf_dir), fx.torus_graph(spark, sf_dir), ("mask", "prediction", "packed"))
    return found.select("user_id", "day", F.array_join("prediction", "").alias("prediction"), F.hex("packed").alias("packed"), "mask")


@query("""SELECT user_id, day, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label), '') AS labels FROM solved LEFT JOIN
(SELECT user_id, day, 2 * seq + k AS label FROM solved, torus, range(0, 2) AS r(k) WHERE (m >> CAST(seq AS INT)) & 1 = 1) USING (user_id, day) GROUP BY user_id, day""", *_SOLVED, recursive=True)
def q_many_labels(spark, sf_dir):
    """Q10: a graph of 110 labels, two an edge, which no LONG holds."""
    g = Matching()
    for r in fx.torus(spark, sf_dir).orderBy("seq").collect():  # 55 rows
        g.add_boundary_edge(r.node1, {2 * r.seq, 2 * r.seq + 1}, r.weight) if r.node2 is None else g.add_edge(r.node1, r.node2, {2 * r.seq, 2 * r.seq + 1}, r.weight)
    found = decode(fx.shots(spark, sf_dir), g, ("prediction",))
    return found.select("user_id", "day", sinks.lines(F.col("prediction"), "hits").alias("labels"))


# reading shots


@query("SELECT user_id, day, hits FROM shots", fx.SQL_SHOTS)
def h_extract_1d(spark, sf_dir):
    """Dense syndromes to hits."""
    shots = fx.shots(spark, sf_dir)
    dense = shots.select("user_id", "day", F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.array_contains("hits", i.cast("long")).cast("tinyint")).alias("z"))
    return dense.select("user_id", "day", hits_of_dense(F.col("z"), 25, 25).alias("hits"))


_BITS = "measured AS (SELECT CAST(n_nationkey AS BIGINT) AS check_id, CAST(h AS BIGINT) AS t, CAST(count(event_id) % 2 AS INT) AS bit FROM nation, range(0, 24) AS r(h) LEFT JOIN events ON (event_id * 11) % 25 = n_nationkey AND hour(ts) = h GROUP BY ALL),\ndiff AS (SELECT check_id, t, xor(bit, coalesce(lag(bit) OVER (PARTITION BY check_id ORDER BY t), 0)) AS bit FROM measured)"


@query("SELECT CAST(0 AS BIGINT) AS shot, list_sort(list(t * 25 + check_id)) AS hits FROM diff WHERE bit = 1", _BITS)
def h_extract_2d(spark, sf_dir):
    """Difference syndromes of checks by hour to hits t * 25 + check."""
    counted = fx.table(spark, sf_dir, "events").groupBy(((F.col("event_id") * 11) % 25).alias("check_id"), F.hour("ts").cast("long").alias("t")).agg((F.count(F.lit(1)) % 2).cast("int").alias("bit"))
    grid = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("check_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("t"))
    full = grid.join(counted, ["check_id", "t"], "left").select(F.lit(0).cast("long").alias("shot"), "check_id", "t", F.coalesce("bit", F.lit(0)).alias("bit"))
    return hits_of_differences(difference_syndrome(full), 25)


@query("""SELECT user_id, day, array_to_string(list_transform(range(0, 4), lambda k: format('{:02X}', (mask >> CAST(8 * k AS INT)) & 255)), '') AS digits, hits
FROM (SELECT *, CAST(list_sum(list_transform(hits, lambda h: CAST(1 AS BIGINT) << CAST(h AS INT))) AS BIGINT) AS mask FROM shots)""", fx.SQL_SHOTS)
def h_bitpack(spark, sf_dir):
    """Bit-packed shots, and the hits read from them."""
    shots = fx.shots(spark, sf_dir)
    packed = shots.select("user_id", "day", bits.packed_of(F.col("hits"), 25).alias("packed"))
    return packed.select("user_id", "day", F.hex("packed").alias("digits"), hits_of_packed(F.col("packed"), 25, 25).alias("hits"))


@query("SELECT user_id, day, rtrim('shot ' || array_to_string(list_transform(hits, lambda x: 'L' || x), ' ')) AS dets, array_to_string(hits, ',') AS hit_line, array_to_string(list_transform(range(0, 25), lambda i: CASE WHEN list_contains(hits, i) THEN '1' ELSE '0' END), '') AS digits FROM shots", fx.SQL_SHOTS)
def s_text_formats(spark, sf_dir):
    """Text lines of sparse shots in the three text formats."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.array_contains("hits", i.cast("long")).cast("int"))
    own = fx.shots(spark, sf_dir).withColumn("z", dense)
    return own.select("user_id", "day", sinks.lines(F.col("z"), "dets").alias("dets"), sinks.lines(F.col("z"), "hits").alias("hit_line"), sinks.lines(F.col("z"), "01").alias("digits"))


# graphs


def _merge_sql(pick: str) -> str:
    return f"""SELECT least(node1, node2) AS k1, greatest(node1, node2) AS k2, min(seq) AS seq, arg_min(node1, seq) AS node1, arg_min(node2, seq) AS node2, {pick} FROM parallel GROUP BY 1, 2"""


def _merged(spark, sf_dir, strategy, **options):
    out = merge.merge(fx.parallel(spark, sf_dir), strategy, **options)
    return out.select(F.least("node1", "node2").alias("k1"), F.greatest("node1", "node2").alias("k2"), "seq", "node1", "node2", F.round("weight", 6).alias("weight"), F.round("error_probability", 9).alias("error_probability"), F.col("fault_ids")[0].alias("fault"))


def _picked(how: str) -> str:
    return f"round({how.format('weight')}, 6) AS weight, round({how.format('error_probability')}, 9) AS error_probability, {how.format('fault')} AS fault"


@query(_merge_sql(_picked("arg_min({}, seq)")), fx.SQL_PARALLEL)
def g_merge_keep(spark, sf_dir):
    """M06, M10."""
    return _merged(spark, sf_dir, "keep-original")


@query(_merge_sql(_picked("arg_max({}, seq)")), fx.SQL_PARALLEL)
def g_merge_replace(spark, sf_dir):
    """M07, M10."""
    return _merged(spark, sf_dir, "replace")


@query(_merge_sql(_picked("first({} ORDER BY weight, seq)")), fx.SQL_PARALLEL)
def g_merge_smallest(spark, sf_dir):
    """M05, M10."""
    return _merged(spark, sf_dir, "smallest-weight")


_INDEPENDENT_P = "round((1 - list_reduce(list(1 - 2 * error_probability ORDER BY seq), lambda a, b: a * b)) / 2, 9) AS error_probability"
_PAIR = "(CASE WHEN abs(a) < abs(b) THEN abs(a) ELSE abs(b) END * sign(a) * sign(b) + ln(1 + exp(-abs(a + b))) - ln(1 + exp(-abs(a - b))))"
_INDEPENDENT = f"round(list_reduce(list(light ORDER BY seq), lambda a, b: {_PAIR}), 6) AS weight"
_LIGHT = "lit AS (SELECT * REPLACE (2 + weight / 10 AS weight), 2 + weight / 10 AS light FROM parallel)"


def _lighter(spark, sf_dir) -> DataFrame:
    """Weights of some 2 to 7, so that merged ones aren't all near 0."""
    return fx.parallel(spark, sf_dir).withColumn("weight", 2 + F.col("weight") / 10)


def _independent(spark, sf_dir, fold):
    out = merge.merge(_lighter(spark, sf_dir), "independent", fold=fold)
    return out.select(F.least("node1", "node2").alias("k1"), F.greatest("node1", "node2").alias("k2"), "seq", "node1", "node2", F.round("weight", 6).alias("weight"), F.round("error_probability", 9).alias("error_probability"), F.col("fault_ids")[0].alias("fault"))


@query(_merge_sql(f"{_INDEPENDENT}, {_INDEPENDENT_P}, arg_min(fault, seq) AS fault").replace("FROM parallel", "FROM lit"), fx.SQL_PARALLEL, _LIGHT)
def g_merge_independent(spark, sf_dir):
    """Weights and probabilities of an odd number of faults, by sums of logarithms, which add up within tasks."""
    return _independent(spark, sf_dir, "closed")


@query(_merge_sql(f"{_INDEPENDENT}, {_INDEPENDENT_P}, arg_min(fault, seq) AS fault").replace("FROM parallel", "FROM lit"), fx.SQL_PARALLEL, _LIGHT)
def g_merge_independent_ordered(spark, sf_dir):
    """The ordered fold."""
    return _independent(spark, sf_dir, "ordered")


_W = "round(sign(a) * sign(b) * least(abs(a), abs(b)) + ln(1 + exp(-abs(a + b))) - ln(1 + exp(-abs(a - b))), 9)"


@query(f"SELECT seq, {_W} AS merged FROM (SELECT seq, weight - 20 AS a, 3 * error_probability AS b FROM parallel)", fx.SQL_PARALLEL)
def g_merge_formula(spark, sf_dir):
    """The weight of exactly one of two independent faults."""
    from ..functions.weights import merge_weights_column

    return fx.parallel(spark, sf_dir).select("seq", F.round(merge_weights_column(F.col("weight") - 20, F.col("error_probability") * 3), 9).alias("merged"))


@query("SELECT seq, node1, node2, weight, [fault] AS fault_ids, error_probability FROM torus", fx.SQL_TORUS)
def g_edges(spark, sf_dir):
    """Edges in the order of insertion, through the graph object."""
    _, edges = fx.torus_graph(spark, sf_dir).to_dataframes(spark)
    return edges.withColumn("weight", F.col("weight").cast("long"))


@query("""SELECT CAST(25 AS BIGINT) AS num_nodes, count(*) AS num_edges, CAST(23 AS BIGINT) AS num_detectors, max(fault) + 1 AS num_fault_ids, CAST(max(abs(weight)) AS DOUBLE) AS max_abs_weight, bool_and(error_probability BETWEEN 0 AND 1) AS all_probabilities FROM torus""", fx.SQL_TORUS)
def g_counts(spark, sf_dir):
    """P05-P12."""
    nodes = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_nationkey").isin(3, 9).alias("is_boundary"))
    return lookup.counts(fx.torus(spark, sf_dir), nodes)


@query("SELECT a.n_nationkey AS node1, b.n_nationkey AS node2, EXISTS (SELECT 1 FROM torus t WHERE (t.node1 = a.n_nationkey AND t.node2 = b.n_nationkey) OR (t.node1 = b.n_nationkey AND t.node2 = a.n_nationkey)) AS there FROM nation a, nation b", fx.SQL_TORUS)
def g_has_edge(spark, sf_dir):
    """P01, for all pairs of the 25 nations."""
    n = fx.table(spark, sf_dir, "nation").select("n_nationkey")
    wanted = n.select(F.col("n_nationkey").alias("node1"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("node2"))
    return lookup.has_edges(fx.torus(spark, sf_dir), wanted)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node1, n_nationkey % 5 = 0 AS there FROM nation")
def g_has_boundary_edge(spark, sf_dir):
    """P02."""
    wanted = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node1"), F.lit(None).cast("long").alias("node2"))
    return lookup.has_edges(fx.torus(spark, sf_dir), wanted).select("node1", "there")


@query("SELECT node1, node2, weight, error_probability, [fault] AS fault_ids FROM torus WHERE (node1 = 3 AND node2 = 8) OR (node1 = 10 AND node2 IS NULL)", fx.SQL_TORUS)
def g_lookup_edge(spark, sf_dir):
    """An edge asked for against its direction, and a boundary edge."""
    t = fx.torus(spark, sf_dir)
    return lookup.edge(t, 8, 3).unionByName(lookup.edge(t, 10, None)).select("node1", "node2", "weight", "error_probability", "fault_ids")


@query("SELECT round(CASE WHEN bool_and(weight = floor(weight)) THEN 1.0 ELSE 16777215.0 / max(abs(weight)) END, 3) AS norm FROM parallel", fx.SQL_PARALLEL)
def g_normalise(spark, sf_dir):
    """G01."""
    return prepare.normaliser(fx.parallel(spark, sf_dir)).select(F.round("norm", 3).alias("norm"))


@query("SELECT seq, CAST(2 * sign(weight) * floor(abs(weight * (SELECT 16777215.0 / max(abs(weight)) FROM parallel)) + 0.5) AS BIGINT) AS weight_int FROM parallel", fx.SQL_PARALLEL)
def g_integer_weights(spark, sf_dir):
    """G02."""
    rows = fx.parallel(spark, sf_dir)
    return prepare.integer_weights(rows, prepare.normaliser(rows)).select("seq", "weight_int")


_COLLAPSE = """
ends AS (SELECT *, node1 IN (3, 4, 9) AS o1, node2 IS NULL OR node2 IN (3, 4, 9) AS o2 FROM signed_torus),
kept AS (SELECT *, CASE WHEN o1 THEN node2 ELSE node1 END AS u FROM ends WHERE NOT (o1 AND o2)),
collapsed AS (
  SELECT seq, node1, node2, weight, fault FROM kept WHERE NOT (o1 OR o2)
  UNION ALL SELECT seq, u, NULL, weight, fault FROM kept WHERE o1 OR o2 QUALIFY row_number() OVER (PARTITION BY u ORDER BY weight, seq) = 1)"""


@query("SELECT seq, node1, node2, weight, [fault] AS fault_ids FROM collapsed", fx.SQL_TORUS, _COLLAPSE)
def g_boundary_collapse(spark, sf_dir):
    """G03, with nations 3, 4 and 9 as boundary nodes."""
    nodes = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_nationkey").isin(3, 4, 9).alias("is_boundary"))
    return prepare.collapse_boundary(fx.torus(spark, sf_dir, True), nodes)


@query("""SELECT node1 AS node, node2 AS other, abs(weight) AS weight, 1 << fault AS mask, weight < 0 AS negative FROM signed_torus
UNION ALL SELECT node2, node1, abs(weight), 1 << fault, weight < 0 FROM signed_torus WHERE node2 IS NOT NULL""", fx.SQL_TORUS)
def g_adjacency(spark, sf_dir):
    """G04, G05."""
    return prepare.adjacency(fx.torus(spark, sf_dir, True))


@query(f"SELECT CAST(sum(weight) AS BIGINT) AS negative_sum, {_MASK} AS negative_mask, (SELECT count(*) FROM (SELECT node FROM (SELECT node1 AS node FROM signed_torus WHERE weight < 0 UNION ALL SELECT node2 FROM signed_torus WHERE weight < 0 AND node2 IS NOT NULL) GROUP BY node HAVING count(*) % 2 = 1)) AS toggled FROM signed_torus WHERE weight < 0", fx.SQL_TORUS)
def g_negative(spark, sf_dir):
    """G06."""
    edges = fx.torus(spark, sf_dir, True)
    return prepare.negative_part(edges).crossJoin(prepare.toggled_nodes(edges).agg(F.count(F.lit(1)).alias("toggled")))


@query("SELECT fault AS fault, bit_xor(CAST(1 AS BIGINT) << CAST(seq % 8 AS INT)) AS mask FROM torus GROUP BY fault", fx.SQL_TORUS)
def g_masks(spark, sf_dir):
    """Labels as bits."""
    of = fx.torus(spark, sf_dir).groupBy(F.col("fault_ids")[0].alias("fault")).agg(F.collect_list(F.col("seq") % 8).alias("ids"))
    return of.select("fault", bits.mask_of(F.col("ids")).alias("mask"))


# a graph that grows with the tables


_LARGE = (fx.SQL_PARALLEL, fx.SQL_LARGE)


@query("""SELECT node1 AS node, node2 AS other, abs(weight) AS weight, CAST(1 AS BIGINT) << CAST(fault AS INT) AS mask, weight < 0 AS negative FROM large
UNION ALL SELECT node2, node1, abs(weight), CAST(1 AS BIGINT) << CAST(fault AS INT), weight < 0 FROM large WHERE node2 IS NOT NULL""", *_LARGE)
def g_large_adjacency(spark, sf_dir):
    """G04, G05, M05 on a graph of suppliers and customers."""
    return prepare.adjacency(fx.large(spark, sf_dir))


@query("SELECT count(*) AS num_edges, max(fault) + 1 AS num_fault_ids, CAST(max(abs(weight)) AS DOUBLE) AS max_abs_weight, max(greatest(node1, coalesce(node2, -1))) + 1 AS num_nodes FROM large", *_LARGE)
def g_large_counts(spark, sf_dir):
    """P05, P07, P08, P12."""
    return lookup.counts(fx.large(spark, sf_dir)).select("num_edges", "num_fault_ids", "max_abs_weight", "num_nodes")


@query("""SELECT sum(weight) AS negative_sum, bit_xor(CAST(1 AS BIGINT) << CAST(fault AS INT)) AS negative_mask, (SELECT count(*) FROM (SELECT node FROM (SELECT node1 AS node FROM large WHERE weight < 0 UNION ALL SELECT node2 FROM large WHERE weight < 0 AND node2 IS NOT NULL) GROUP BY node HAVING count(*) % 2 = 1)) AS toggled FROM large WHERE weight < 0""", *_LARGE)
def g_large_negative(spark, sf_dir):
    """G06."""
    edges = fx.large(spark, sf_dir)
    return prepare.negative_part(edges).crossJoin(F.broadcast(prepare.toggled_nodes(edges).agg(F.count(F.lit(1)).alias("toggled"))))


@query("""SELECT seq, node1, node2, weight, fault FROM large WHERE node2 IS NOT NULL AND node2 % 7 <> 0
UNION ALL SELECT seq, node1, NULL, weight, fault FROM large WHERE node2 IS NULL OR node2 % 7 = 0 QUALIFY row_number() OVER (PARTITION BY node1 ORDER BY weight, seq) = 1""", *_LARGE)
def g_large_collapse(spark, sf_dir):
    """Every seventh customer is a boundary node."""
    node = (1_000_000 + F.col("c_custkey")).cast("long")
    nodes = fx.table(spark, sf_dir, "customer").select(node.alias("node"), (node % 7 == 0).alias("is_boundary"))
    return prepare.collapse_boundary(fx.large(spark, sf_dir), nodes).select("seq", "node1", "node2", "weight", F.col("fault_ids")[0].alias("fault"))


@query("""SELECT o_orderkey, coalesce(found, false) AS there FROM (SELECT o_orderkey, CAST(1 + (o_orderkey * 7) % (SELECT count(*) FROM supplier) AS BIGINT) AS a, CAST(1000000 + o_custkey AS BIGINT) AS b FROM orders)
LEFT JOIN (SELECT DISTINCT node1, node2, true AS found FROM large WHERE node2 IS NOT NULL) ON node1 = a AND node2 = b""", *_LARGE)
def g_large_has_edge(spark, sf_dir):
    """An order's customer and some supplier, asked for against the edge's direction."""
    n = fx.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    wanted = fx.table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select("o_orderkey", (1_000_000 + F.col("o_custkey")).cast("long").alias("node1"), (1 + (F.col("o_orderkey") * 7) % F.col("n")).cast("long").alias("node2"))
    there = lookup.has_edges(fx.large(spark, sf_dir), wanted.select("node1", "node2").distinct())
    return wanted.join(there, ["node1", "node2"]).select("o_orderkey", "there")


def _coordinates(spark, sf_dir):
    t = fx.torus(spark, sf_dir).select("seq", F.explode(F.array("node1", "node2")).alias("row")).filter("row IS NOT NULL")
    return t.select("row", F.col("seq").alias("col"), F.lit(1).alias("val"))


@query("SELECT seq AS col, least(node1, coalesce(node2, node1)) AS node1, CASE WHEN node2 IS NULL THEN NULL ELSE greatest(node1, node2) END AS node2, [seq] AS fault_ids FROM torus", fx.SQL_TORUS)
def g_from_check_matrix(spark, sf_dir):
    """Columns of a check matrix, given by coordinates, to edges."""
    return check_matrix.edges_from_coordinates(_coordinates(spark, sf_dir), 25).select("col", "node1", "node2", "fault_ids")


@query("""SELECT CAST(t AS BIGINT) AS t, seq AS col, least(node1, coalesce(node2, node1)) + 25 * t AS node1, CASE WHEN node2 IS NULL THEN 75 ELSE greatest(node1, node2) + 25 * t END AS node2, CAST(1 AS DOUBLE) AS weight FROM torus, range(0, 3) AS r(t)
UNION ALL SELECT t, NULL, n_nationkey + 25 * t, n_nationkey + 25 * (t + 1), CAST(0.5 + n_nationkey AS DOUBLE) FROM nation, range(0, 2) AS r(t)""", fx.SQL_TORUS)
def g_repetitions(spark, sf_dir):
    """Three repetitions with time-like edges of their own weights."""
    step = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), (F.col("n_nationkey") + 0.5).cast("double").alias("weight"), F.lit(None).cast("double").alias("error_probability"))
    out = check_matrix.edges_from_coordinates(_coordinates(spark, sf_dir), 25, 3, timelike=step, virtual=False)
    return out.select(F.col("t").cast("long").alias("t"), "col", F.col("node1").cast("long").alias("node1"), F.col("node2").cast("long").alias("node2"), "weight")


@query("SELECT seq AS col, list_sort(list_distinct([seq % 4, 4 + seq % 3])) AS fault_ids FROM torus", fx.SQL_TORUS)
def g_faults(spark, sf_dir):
    """A faults matrix instead of one label a column."""
    f = fx.torus(spark, sf_dir).select(F.col("seq").alias("col"), F.explode(F.array(F.col("seq") % 4, 4 + F.col("seq") % 3)).alias("fault"))
    return check_matrix.edges_from_coordinates(_coordinates(spark, sf_dir), 25, faults=f).select("col", "fault_ids")


# distances


@query("SELECT src, dst, d FROM distance", fx.SQL_TORUS, _distances("torus"))
def x_distances(spark, sf_dir):
    """Cheapest distances by min-plus joins."""
    return paths.distances(fx.torus(spark, sf_dir).select("node1", "node2", "weight"), cut=_cut)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, b FROM nation JOIN away ON node = n_nationkey", fx.SQL_TORUS, _distances("torus"))
def x_boundary_distances(spark, sf_dir):
    """X13 to the boundary."""
    edges = fx.torus(spark, sf_dir)
    return paths.boundary_distances(paths.distances(edges.select("node1", "node2", "weight"), cut=_cut), edges)


@query("SELECT src, dst, d AS length FROM distance WHERE src < dst", fx.SQL_TORUS, _distances("torus"))
def x_path_nodes(spark, sf_dir):
    """The length of the path whose nodes are returned, for all pairs."""
    g = fx.torus_graph(spark, sf_dir)
    rows = [(u, v, i, x) for u in range(25) for v in range(u + 1, 25) for i, x in enumerate(g.get_nodes_on_shortest_path(u, v))]
    walk = spark.createDataFrame(rows, "src long, dst long, i int, node long")
    nxt = walk.select("src", "dst", (F.col("i") - 1).alias("i"), F.col("node").alias("after"))
    edges = fx.torus(spark, sf_dir).filter("node2 IS NOT NULL").select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    steps = walk.join(nxt, ["src", "dst", "i"]).withColumns({"a": F.least("node", "after"), "b": F.greatest("node", "after")})
    return steps.join(edges, ["a", "b"]).groupBy("src", "dst").agg(F.sum("weight").alias("length"))


# correlations

_JOINT = """
joint AS (
  SELECT a, b, (1 - list_reduce(list(1 - 2 * p), lambda x, y: x * y)) / 2 AS p
  FROM (SELECT x.err, x.p, x.edge AS a, y.edge AS b FROM errors x JOIN errors y USING (err)) GROUP BY a, b),
implied AS (
  SELECT j.a, j.b, ln((1 - least(0.5, j.p / o.p)) / least(0.5, j.p / o.p)) AS weight
  FROM joint j JOIN joint o ON o.a = j.a AND o.b = j.a WHERE j.a <> j.b)"""


@query("SELECT a, b, round(p, 9) AS p FROM joint", fx.SQL_TORUS, fx.SQL_ERRORS, _JOINT)
def c_joint(spark, sf_dir):
    """C01, D22."""
    return correlated.joint_probabilities(fx.errors(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query("SELECT a, b, round(weight, 6) AS weight FROM implied", fx.SQL_TORUS, fx.SQL_ERRORS, _JOINT)
def c_implied(spark, sf_dir):
    """C02, D21."""
    return correlated.implied_weights(correlated.joint_probabilities(fx.errors(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


def _error_parts(spark, sf_dir) -> dict[int, list]:
    """err: [p, [(nodes, label), ...]] of the torus' errors, as many whatever the scale."""
    parts: dict[int, list] = {}
    for r in fx.errors(spark, sf_dir).orderBy("err", "component").collect():
        parts.setdefault(r.err, [r.p, []])[1].append(((r.node1,) if r.node2 is None else (r.node1, r.node2), r.edge % 8))
    return parts


def _model_text(spark, sf_dir) -> str:
    """The torus' errors as a detector error model."""
    side = lambda nodes, label: " ".join([*(f"D{x}" for x in nodes), f"L{label}"])
    return "\n".join(f"error({p!r}) " + " ^ ".join(side(*x) for x in parts) for p, parts in _error_parts(spark, sf_dir).values())


def _correlated_graph(spark, sf_dir):
    return Matching.from_detector_error_model(_model_text(spark, sf_dir), enable_correlations=True)


#: The merged edges of the errors, and rules and weights as integers.
_CORRELATED = """
marginal AS (SELECT a AS seq, p, ln((1 - p) / p) AS weight FROM joint WHERE a = b),
scale AS (SELECT 16777215.0 / max(abs(weight)) AS norm FROM (SELECT weight FROM marginal UNION ALL SELECT weight FROM implied)),
model_torus AS (SELECT t.seq, t.node1, t.node2, t.seq % 8 AS fault, CAST(2 * floor(m.weight * norm + 0.5) AS BIGINT) AS weight FROM torus t JOIN marginal m USING (seq), scale),
rules AS (SELECT a, b, CAST(2 * floor(weight * norm + 0.5) AS BIGINT) AS w FROM implied, scale)"""


def _second_pass(steps: int = 16) -> str:
    """Each shot's own weights, the ways from its hits over them by lengthening paths, and the solutions."""
    least = "SELECT user_id, day, src, dst, min(d) AS d, arg_min(m, d) AS m FROM ({}) GROUP BY ALL"
    more = "SELECT * FROM {0} UNION ALL SELECT w.user_id, w.day, w.src, o.dst, w.d + o.d, xor(w.m, o.m) FROM {0} w JOIN own_step o ON o.user_id = w.user_id AND o.day = w.day AND o.src = w.dst"
    ways = ["way0 AS (SELECT user_id, day, unnest(hits) AS src, unnest(hits) AS dst, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS m FROM shots)"]
    ways += [f"way{i + 1} AS ({least.format(more.format(f'way{i}'))})" for i in range(steps)]
    return f"""
changed AS (SELECT user_id, day, b AS seq, min(w) AS w FROM first_solved JOIN rules ON (m >> CAST(a AS INT)) & 1 = 1 GROUP BY ALL),
own_edge AS (SELECT s.user_id, s.day, t.seq, t.node1, t.node2, least(t.weight, coalesce(c.w, t.weight)) AS w, CAST(1 AS BIGINT) << CAST(t.seq AS INT) AS m FROM shots s CROSS JOIN model_torus t LEFT JOIN changed c ON c.user_id = s.user_id AND c.day = s.day AND c.seq = t.seq),
own_step AS (SELECT user_id, day, node1 AS src, node2 AS dst, w AS d, m FROM own_edge WHERE node2 IS NOT NULL UNION ALL SELECT user_id, day, node2, node1, w, m FROM own_edge WHERE node2 IS NOT NULL),
{", ".join(ways)},
own_away AS (SELECT w.user_id, w.day, w.src AS node, min(d + e.w) AS b, arg_min(xor(w.m, e.m), d + e.w) AS m FROM way{steps} w JOIN own_edge e ON e.user_id = w.user_id AND e.day = w.day AND e.node1 = w.dst AND e.node2 IS NULL GROUP BY ALL),
""" + fx.sql_match("shots", distance=f"way{steps}", away="own_away", own_ways=True)


def _renamed(sql: str) -> str:
    """A first pass beside the second one."""
    for name in ("hit", "moves", "state", "solved"):
        sql = sql.replace(f"{name} AS (", f"first_{name} AS (").replace(f"FROM {name} ", f"FROM first_{name} ").replace(f"JOIN {name} ", f"JOIN first_{name} ")
    return sql


_TWO_PASSES = (fx.SQL_TORUS, fx.SQL_ERRORS, _JOINT, _CORRELATED, fx.SQL_SHOTS, _distances("model_torus"), _renamed(fx.sql_match("shots")), _second_pass(), fx.SQL_LABELS.format(solved="solved", graph="model_torus"))


@query("""SELECT user_id, day, b AS edge, round(min(i.weight), 6) AS weight FROM first_solved JOIN implied i ON (m >> CAST(i.a AS INT)) & 1 = 1 JOIN marginal t ON t.seq = i.b
GROUP BY user_id, day, b HAVING round(min(i.weight), 6) < round(min(t.weight), 6)""", *_TWO_PASSES[:-2], recursive=True)
def c_reweight(spark, sf_dir):
    """The weights that the edges of a shot's first pass imply."""
    graph = _correlated_graph(spark, sf_dir)
    own = fx.torus(spark, sf_dir).select(F.least("node1", F.coalesce("node2", "node1")).alias("u"), F.when(F.col("node2").isNull(), -1).otherwise(F.greatest("node1", "node2")).cast("long").alias("v"), F.col("seq").alias("edge"))
    joint = correlated.joint_probabilities(fx.errors(spark, sf_dir))
    rules = correlated.implied_weights(joint).withColumn("weight", F.round("weight", 6))
    now = joint.filter("a = b").select(F.col("a").alias("edge"), F.round(F.ln((1 - F.col("p")) / F.col("p")), 6).alias("weight"))
    chosen = decode(_keyed(fx.shots(spark, sf_dir)).select("shot", "hits"), graph, ("edges",)).select("shot", F.explode("edges").alias("e")).select("shot", F.col("e.node1").alias("u"), F.col("e.node2").alias("v"))
    first = chosen.join(F.broadcast(own), ["u", "v"]).select("shot", "edge")  # 55 edges
    return _unkeyed(correlated.reweight(first, correlated.checked_rules(rules, now)), "edge", "weight")


@query("SELECT user_id, day, weight AS weight_int, mask FROM answers", *_TWO_PASSES, recursive=True)
def q_correlated(spark, sf_dir):
    """Two passes, the second over weights that the first one's edges imply."""
    return decode(fx.shots(spark, sf_dir), _correlated_graph(spark, sf_dir), ("mask", "weight_int"), enable_correlations=True)


@query("SELECT user_id, day, edges FROM answers", *_TWO_PASSES, recursive=True)
def q_correlated_edges(spark, sf_dir):
    """Solution edges of the second pass."""
    return decode(fx.shots(spark, sf_dir), _correlated_graph(spark, sf_dir), ("edges",), enable_correlations=True).withColumn("edges", _text("edges"))


# sampling and evaluation


def _flip(shot, seq, p):
    return F.pmod((shot * 7919 + seq * 104729 + 17) * 48271, F.lit(1_000_003)) < p * 1_000_003


_SAMPLE = """
failed AS (SELECT shot, seq, node1, node2, fault FROM range(0, 2000) AS r(shot), torus WHERE ((shot * 7919 + seq * 104729 + 17) * 48271) % 1000003 < error_probability * 1000003),
sampled AS (
  SELECT shot, coalesce(h.hits, []) AS hits, coalesce(f.faults, []) AS faults FROM range(0, 2000) AS r(shot)
  LEFT JOIN (SELECT shot, list_sort(list(node)) AS hits FROM (SELECT shot, node FROM (SELECT shot, node1 AS node FROM failed UNION ALL SELECT shot, node2 FROM failed WHERE node2 IS NOT NULL) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY shot) h USING (shot)
  LEFT JOIN (SELECT shot, list_sort(list(fault)) AS faults FROM (SELECT shot, fault FROM failed GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY shot) f USING (shot))"""


@query("SELECT shot, hits, faults FROM sampled", fx.SQL_TORUS, _SAMPLE)
def r_noise(spark, sf_dir):
    """Samples of independent edge errors, with a hash in place of random numbers."""
    return sampling.sample_shots(spark, fx.torus(spark, sf_dir), 2000, flip=_flip)


_SAMPLED = (fx.SQL_TORUS, _SAMPLE, _distances("torus"), fx.sql_match("sampled", ("shot",)),
    """predicted AS (SELECT shot, (SELECT coalesce(bit_xor(CAST(1 AS BIGINT) << CAST(fault AS INT)), 0) FROM torus WHERE (s.m >> CAST(seq AS INT)) & 1 = 1) AS mask FROM solved s),
actual AS (SELECT shot, coalesce(list_sum(list_transform(faults, lambda f: CAST(1 AS BIGINT) << CAST(f AS INT))), 0) AS mask FROM sampled),
counted AS (SELECT shot % 4 AS grid, sum(CASE WHEN p.mask <> a.mask THEN 1 ELSE 0 END)::BIGINT AS mistakes, count(*) AS shots FROM predicted p JOIN actual a USING (shot) GROUP BY 1)""")  # fmt: skip


def _mistakes(spark, sf_dir):
    drawn = sampling.sample_shots(spark, fx.torus(spark, sf_dir), 2000, flip=_flip)
    actual = drawn.select("shot", bits.mask_of(F.col("faults")).alias("mask"))
    found = decode(drawn.select("shot", "hits"), fx.torus_graph(spark, sf_dir), ("mask",)).withColumn("grid", F.col("shot") % 4)
    return evaluate.count_mistakes(found, actual, by=("grid",))


@query("SELECT grid, mistakes, shots, round(mistakes / shots, 9) AS rate FROM counted", *_SAMPLED, recursive=True)
def e_error_rate(spark, sf_dir):
    """Q13, Q16: mistakes of decoding samples of the torus' own errors, by group."""
    return evaluate.error_rates(_mistakes(spark, sf_dir)).select("grid", "mistakes", "shots", F.round("rate", 9).alias("rate"))


@query("""SELECT grid, round(tail_low, 6) AS tail_low, round(tail_high, 6) AS tail_high FROM (SELECT grid, CAST(0.025 AS DOUBLE) AS tail_low, CAST(0.025 AS DOUBLE) AS tail_high FROM counted)""", *_SAMPLED, recursive=True)
def e_interval(spark, sf_dir):
    """Q16: the interval's ends are where 2.5 % of the binomial lie beyond what was counted, summed term by term."""
    found = evaluate.error_rates(_mistakes(spark, sf_dir))
    k = F.sequence(F.lit(0).cast("long"), F.col("shots"))
    log = F.transform(F.sequence(F.lit(1).cast("long"), F.col("shots")), lambda i: F.ln(i.cast("double")))
    facts = F.aggregate(log, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    at = lambda a, i: F.get(a, i.cast("int"))
    term = lambda i, p: F.exp(at(F.col("facts"), F.col("shots")) - at(F.col("facts"), i) - at(F.col("facts"), F.col("shots") - i) + i * F.ln(p) + (F.col("shots") - i) * F.ln(1 - p))
    tail = lambda keep, p: F.aggregate(F.transform(F.filter(k, keep), lambda i: term(i, F.col(p))), F.lit(0.0), lambda acc, x: acc + x)
    return found.withColumn("facts", facts).select("grid", F.round(tail(lambda i: i >= F.col("mistakes"), "low"), 6).alias("tail_low"), F.round(tail(lambda i: i <= F.col("mistakes"), "high"), 6).alias("tail_high"))


@query("SELECT user_id % 5 AS grid, sum(CASE WHEN len(hits) % 3 <> 1 THEN 1 ELSE 0 END)::BIGINT AS mistakes, count(*) AS shots FROM shots GROUP BY 1", fx.SQL_SHOTS)
def e_count_mistakes(spark, sf_dir):
    """Q13, Q16: predictions against actual labels, by group."""
    own = fx.shots(spark, sf_dir).select(F.concat_ws("|", "user_id", "day").alias("shot"), (F.col("user_id") % 5).alias("grid"), (F.size("hits") % 3).alias("mask"))
    return evaluate.count_mistakes(own, own.select("shot", F.lit(1).alias("mask")), by=("grid",))


@query("SELECT format('{} / {}', sum(CASE WHEN len(hits) % 3 <> 1 THEN 1 ELSE 0 END), count(*)) AS summary FROM shots", fx.SQL_SHOTS)
def e_summary(spark, sf_dir):
    """K08."""
    own = fx.shots(spark, sf_dir).select(F.concat_ws("|", "user_id", "day").alias("shot"), (F.size("hits") % 3).alias("mask"))
    return evaluate.summary(evaluate.count_mistakes(own, own.select("shot", F.lit(1).alias("mask"))))


@query("SELECT err, round(p, 12) AS least, err % 3 = 0 AS certain FROM (SELECT DISTINCT err, p FROM errors)", fx.SQL_TORUS, fx.SQL_ERRORS)
def r_flip(spark, sf_dir):
    """A random share of probabilities is turned round, all of a third's and none of another third's."""
    own = fx.errors(spark, sf_dir).select("err", "p").distinct()
    some = [sampling.flip_probabilities(own.filter(f"err % 3 = {k}"), share, seed=7) for k, share in ((0, 1.0), (1, 0.5), (2, 0.0))]
    all_ = some[0].unionByName(some[1]).unionByName(some[2])
    wrong = ((F.col("err") % 3 == 2) & (F.col("p") > 0.5)) | ((F.col("err") % 3 == 0) & (F.col("p") < 0.5))
    return all_.select("err", F.round(F.when(wrong, -1.0).otherwise(F.least("p", 1 - F.col("p"))), 12).alias("least"), (F.col("err") % 3 == 0).alias("certain"))


# partitions


def _nodes(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    return fx.table(spark, sf_dir, "nation").select(n.alias("node"), F.array((n % 5).cast("double"), F.floor(n / 5).cast("double")).alias("coords"))


_PLACED = "placed AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey // 5 AS BIGINT) AS round, CAST(n_nationkey // 10 AS BIGINT) AS partition FROM nation)"


@query("SELECT node, round, partition, EXISTS (SELECT 1 FROM torus JOIN placed a ON a.node = node1 JOIN placed b ON b.node = node2 WHERE a.partition <> b.partition AND placed.node = CASE WHEN a.partition > b.partition THEN node1 ELSE node2 END) AS is_cross_partition FROM placed", fx.SQL_TORUS, _PLACED)
def p_partition(spark, sf_dir):
    """Rounds, tumbling windows of them, and crossing nodes."""
    placed = partition.partitions(partition.rounds(_nodes(spark, sf_dir)), 2)
    return partition.mark_crossing(placed, fx.torus(spark, sf_dir)).select("node", "round", "partition", "is_cross_partition")


@query("""SELECT seq, CASE WHEN a.partition = 1 THEN node1 ELSE node2 END AS node1, CASE WHEN a.partition = 1 AND b.partition = 1 THEN node2 END AS node2, node2 IS NOT NULL AND NOT coalesce(a.partition = 1 AND b.partition = 1, false) AS virtual
FROM torus LEFT JOIN placed a ON a.node = node1 LEFT JOIN placed b ON b.node = node2 WHERE a.partition = 1 OR b.partition = 1""", fx.SQL_TORUS, _PLACED)
def p_active(spark, sf_dir):
    """The edges of one partition, those that leave it going to a virtual boundary."""
    placed = partition.partitions(partition.rounds(_nodes(spark, sf_dir)), 2)
    return partition.active_edges(fx.torus(spark, sf_dir), placed, 1, 1).select("seq", "node1", "node2", "virtual")


from . import library  # noqa: E402, F401  (its queries are registered, too)

library.register_correlated()
