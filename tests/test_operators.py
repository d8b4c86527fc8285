"""DataFrame operators against the graph object and against each other."""

import random

import pytest
from pyspark.sql import functions as F

from pairweave import Matching
from pairweave.functions import bits
from pairweave.functions.weights import merge_weights
from pairweave.operators import correlated, evaluate, merge, partition, paths, prepare, sampling
from pairweave.operators.decode import decode, decode_by_component, hits_of_dense, hits_of_packed, small_shots
from pairweave.sinks import shots as sinks
from pairweave.streaming.decode_stream import decode_stream, shots_of_events


def random_matching(seed, n=12, negative=False):
    r = random.Random(seed)
    m = Matching()
    for i in range(n):
        m.add_edge(i, (i + 1) % n, fault_ids=i % 6, weight=r.randint(1, 9))
    for _ in range(n):
        u, v = r.sample(range(n), 2)
        m.add_edge(u, v, fault_ids={u % 6, 5}, weight=r.randint(-3 if negative else 1, 9), merge_strategy="smallest-weight")
    for u in (0, n // 2):
        m.add_boundary_edge(u, fault_ids=u % 6, weight=r.randint(2, 7))
    return m


def random_shots(spark, seed, n, count=200):
    r = random.Random(seed)
    return spark.createDataFrame([(i, sorted(r.sample(range(n), r.randint(0, 7)))) for i in range(count)], "shot long, hits array<long>")


@pytest.mark.parametrize("negative", [False, True])
def test_decode_is_the_kernel(spark, negative):
    m, shots = random_matching(1, negative=negative), random_shots(spark, 2, 12)
    outputs = ("mask", "prediction", "packed", "weight", "weight_int", "edges")
    for r in decode(shots.withColumn("raw", F.col("hits")), m, outputs).collect():
        z = [int(i in r.raw) for i in range(12)]
        c, w = m.decode(z, return_weight=True)
        assert r.prediction == c.tolist() and r.weight == w == r.weight_int / m.compiled().scale
        assert r.mask == sum(int(b) << i for i, b in enumerate(c)) and int.from_bytes(r.packed, "little") == r.mask
        assert [tuple(e) for e in r.edges] == sorted(map(tuple, m.decode_to_edges_array(z).tolist()))


def test_parts_components_and_relational_forms_agree(spark):
    m, shots = random_matching(3), random_shots(spark, 4, 12)
    nodes, edges = m.to_dataframes(spark)
    want = {r.shot: (r.mask, r.weight_int) for r in decode(shots, m, ("mask", "weight_int")).collect()}
    parts = {r.shot: (r.mask, r.weight_int) for r in partition.decode_in_parts(shots, m).collect()}
    assert {k: w for k, (_, w) in parts.items()} == {k: w for k, (_, w) in want.items()}
    by = decode_by_component(shots, edges, nodes.select("node", F.lit(0).alias("comp")), 1.0)
    assert {r.shot: r.weight_int for r in by.collect()} == {k: w for k, (_, w) in want.items()}
    table = paths.distances(edges.select("node1", "node2", F.col("weight").cast("long").alias("weight")))
    small = small_shots(shots, table, paths.boundary_distances(table, edges).withColumn("b", F.col("b").cast("long")))
    assert {r.shot: 2 * r.weight for r in small.collect()} == {k: w for k, (_, w) in want.items()}


def test_components_are_solved_in_blocks(spark):
    """A connected graph is one component, whose shots meet its edges in many tasks; two of them add up."""
    m, shots = random_matching(3), random_shots(spark, 4, 12, 200)
    _, edges = m.to_dataframes(spark)
    edges = edges.select("node1", "node2", "weight", "fault_ids")
    comp = paths.connected(edges)
    assert {r.comp for r in comp.collect()} == {0} and comp.count() == 12
    want = {r.shot: (r.mask, r.weight_int) for r in decode(shots, m, ("mask", "weight_int")).collect()}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = decode_by_component(shots, edges, comp, 1.0, block=10)
    assert {r.shot: r.weight_int for r in found.collect()} == {k: w for k, (_, w) in want.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    two = edges.unionByName(edges.select((F.col("node1") + 12).alias("node1"), (F.col("node2") + 12).alias("node2"), "weight", "fault_ids"))
    twice = shots.select("shot", F.concat("hits", F.transform("hits", lambda x: x + 12)).alias("hits"))
    found = decode_by_component(twice, two, paths.connected(two), 1.0)
    assert {r.shot: r.weight_int for r in found.collect()} == {k: 2 * w for k, (_, w) in want.items()}


@pytest.mark.parametrize("weights", [[3.0], [100.0], [40.0, 45.0], [40.0, 40.0, 2.5], [100.0, 100.0], [511.0, 513.0, 512.5], [16777215.0] * 3, [16777215.0, 1023.0, 1025.0], [0.0, 5.0], [-3.0, 4.0, -0.5], [-900.0, 901.0], [1e-9, 2.0], [700.0, 0.1]])
def test_independent_merge_is_stable(spark, weights):
    rows = [(i, 1, 0, w, 0.1 * (i % 9), [0]) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "seq long, node1 long, node2 long, weight double, error_probability double, fault_ids array<long>")
    want = weights[0]
    for w in weights[1:]:
        want = merge_weights(want, w)
    for fold in ("closed", "ordered"):
        got = merge.merge(df, "independent", fold=fold).first()
        assert got.weight == pytest.approx(want, rel=1e-9, abs=1e-12) and (got.node1, got.node2) == (1, 0)


def test_infeasible_shots(spark):
    m = Matching()
    m.add_edge(0, 1)
    shots = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, None)], "shot long, hits array<long>")
    with pytest.raises(Exception, match="No perfect matching"):
        decode(shots, m).collect()
    got = {r.shot: (r.weight, r.status) for r in decode(shots, m, on_error="null").collect()}
    assert got[1] == (1.0, "ok") and got[2] == (0.0, "ok") and got[0][0] is None and got[0][1].startswith("No perfect")
    with pytest.raises(ValueError):
        decode(shots, m, ("nothing",))
    with pytest.raises(Exception, match="not a node"):
        decode(spark.createDataFrame([(0, [7])], "shot long, hits array<long>"), m).collect()


def test_many_fault_ids_need_arrays(spark):
    m = Matching()
    m.add_edge(0, 1, fault_ids={70})
    shots = spark.createDataFrame([(0, [0, 1])], "shot long, hits array<long>")
    with pytest.raises(Exception, match="64"):
        decode(shots, m, ("mask",)).collect()
    assert decode(shots, m, ("prediction",)).first().prediction[70] == 1


def test_empty_shots(spark):
    m = random_matching(1)
    assert decode(spark.createDataFrame([], "shot long, hits array<long>"), m).count() == 0


@pytest.mark.parametrize("strategy", merge.STRATEGIES[1:])
def test_merges_are_those_of_the_graph(spark, strategy):
    r = random.Random(7)
    rows = [(i, r.randrange(4), r.choice([None, 0, 1, 2, 3]), r.choice([-1.5, 0.5, 1.0, 2.25, 3.0]), r.choice([None, 0.1, 0.2, 0.5]), [i]) for i in range(60)]
    m = Matching()
    for _, u, v, w, p, f in rows:
        m.add_boundary_edge(u, f, w, p, merge_strategy=strategy) if v is None else m.add_edge(u, v, f, w, p, merge_strategy=strategy)
    df = spark.createDataFrame(rows, "seq long, node1 long, node2 long, weight double, error_probability double, fault_ids array<long>")
    for fold in ("ordered", "closed") if strategy == "independent" else ("ordered",):
        got = merge.merge(df, strategy, fold).orderBy("seq").collect()
        assert [(x.node1, x.node2, set(x.fault_ids)) for x in got] == [(u, v, d["fault_ids"]) for u, v, d in m.edges()]
        for x, (_, _, d) in zip(got, m.edges()):
            assert x.weight == pytest.approx(d["weight"], abs=1e-9)
            assert (-1.0 if x.error_probability is None else x.error_probability) == pytest.approx(d["error_probability"], abs=1e-12)
    with pytest.raises(Exception, match="parallel edges"):
        merge.merge(df, "disallow").collect()
    with pytest.raises(ValueError):
        merge.merge(df, "other")


def test_limits_and_normaliser(spark):
    df = spark.createDataFrame([(0, 0, 1, 2.0**25, None, [0]), (1, 0, 1, 1.5, None, [0])], "seq long, node1 long, node2 long, weight double, error_probability double, fault_ids array<long>")
    assert merge.within_limit(df).count() == 1
    assert prepare.normaliser(merge.within_limit(df)).first().norm == 16777215 / 1.5
    with pytest.raises(Exception, match="exceeded"):
        prepare.normaliser(df).collect()


def test_bits(spark):
    df = spark.createDataFrame([([0, 63, 5, 5], [1, 0, 1, 1, 0, 0, 0, 0, 1], bytearray(b"\x05\x80")), ([], [], bytearray())], "ids array<long>, b array<int>, packed binary")
    a, b = df.select(bits.mask_of(F.col("ids")).alias("m"), bits.pack_bits(F.col("b")).alias("p"), bits.set_bits(F.col("packed")).alias("s")).collect()
    assert a.m == 1 - (1 << 63) and bytes(a.p) == b"\x0d\x01" and a.s == [0, 2, 15]
    assert b.m == 0 and bytes(b.p or b"") == b"" and b.s == []


def test_hit_columns(spark):
    df = spark.createDataFrame([([0, 1, 1], bytearray(b"\x06"))], "z array<int>, p binary")
    r = df.select(hits_of_dense(F.col("z"), 3, 3).alias("a"), hits_of_packed(F.col("p"), 3, 3).alias("b")).first()
    assert r.a == r.b == [1, 2]
    with pytest.raises(Exception, match="doesn't fit"):
        df.select(hits_of_dense(F.col("z"), 4, 4)).collect()


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(i, [i % 2, 1]) for i in range(50)], "shot long, prediction array<int>")
    sinks.write(df, str(tmp_path / "out"), "dets")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted(["shot L1", "shot L0 L1"] * 25)


def test_sampling_statistics(spark):
    edges = spark.createDataFrame([(0, 0, 1, [0], 1.0), (1, 1, 2, [1], 0.0), (2, 2, None, [0, 2], 0.3)], "seq long, node1 long, node2 long, fault_ids array<long>, error_probability double")
    rows = sampling.sample_shots(spark, edges, 4000, seed=1).collect()
    both = sum(r.faults == [2] for r in rows)
    assert all((r.hits, r.faults) in (([0, 1], [0]), ([0, 1, 2], [2])) for r in rows)
    assert abs(both - 1200) < 5 * (4000 * 0.21) ** 0.5
    outer = spark.createDataFrame([(1,)], "node long")
    assert all(1 not in r.hits for r in sampling.sample_shots(spark, edges, 50, boundary=outer).collect())


def test_error_rates(spark):
    low, high = evaluate.binomial_interval(10, 100)
    assert (round(low, 4), round(high, 4)) == (0.0490, 0.1762)
    assert evaluate.binomial_interval(0, 10)[0] == 0 and evaluate.binomial_interval(10, 10)[1] == 1
    a = spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "shot long, mask long")
    b = spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "shot long, mask long")
    assert evaluate.summary(evaluate.count_mistakes(a, b)).first().summary == "1 / 3"
    found = evaluate.error_rates(evaluate.count_mistakes(a, b)).first()
    assert found.rate == pytest.approx(1 / 3) and (found.low, found.high) == pytest.approx(evaluate.binomial_interval(1, 3))
    with pytest.raises(Exception, match="end before"):
        evaluate.count_mistakes(a, b.limit(1)).collect()


def test_rule_checks(spark):
    rules = spark.createDataFrame([(0, 1, 2.0)], "a long, b long, weight double")
    for edges, what in (([(0, 1.0)], "isn't an edge"), ([(1, -1.0)], "sign")):
        with pytest.raises(Exception, match=what):
            correlated.checked_rules(rules, spark.createDataFrame(edges, "edge long, weight double")).collect()


def test_streams(spark, tmp_path):
    m, shots = random_matching(5), random_shots(spark, 6, 12, 40)
    shots.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shots.schema).parquet(str(tmp_path / "in"))
    q = decode_stream(stream, m, ("weight",)).writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("decoded").collect()} == {tuple(r) for r in decode(shots, m, ("weight",)).collect()}
    events = spark.createDataFrame([(1, "2024-01-01 01:00:00", 3), (1, "2024-01-01 02:00:00", 3), (1, "2024-01-01 03:00:00", 4), (2, "2024-01-01 03:00:00", 5), (2, "2024-01-05 03:00:00", 6)], "user_id long, ts string, node long").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = shots_of_events(s).select("user_id", "hits").writeStream.format("memory").queryName("gathered").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.user_id, tuple(r.hits)) for r in spark.table("gathered").collect()} == {(1, (4,)), (2, (5,)), (2, (6,))}


def test_windows_of_time_add_up(spark):
    """Groups within a window are solved there, those over a border by the windows they join; together they are the whole shot."""
    m, shots = random_matching(7), random_shots(spark, 8, 12)
    nodes = spark.createDataFrame([(i, i // 3) for i in range(12)], "node long, partition long")
    want = {r.shot: (r.mask, r.weight_int) for r in decode(shots, m, ("mask", "weight_int")).collect()}
    found: dict[int, list] = {}
    for r in partition.decode_windows(shots, m, nodes).collect():
        assert 0 <= r.first <= r.last <= 3
        found.setdefault(r.shot, []).append((r.mask, r.weight_int))
    for shot, (_, weight) in want.items():
        assert sum(w for _, w in found.get(shot, [])) == weight
    assert max(map(len, found.values())) > 1
    alone = partition.decode_windows(shots, m, nodes.withColumn("partition", F.lit(0).cast("long"))).collect()
    assert all((r.first, r.last) == (0, 0) for r in alone) and {r.shot: r.weight_int for r in alone} == {k: w for k, (_, w) in want.items() if k in {r.shot for r in alone}}
