"""The graph object: building, merging, loading, looking, exporting and errors."""

import contextlib
import math
import random

import numpy as np
import pytest

from pairweave import Matching, rand_float, set_seed
from pairweave.functions.weights import MAX_WEIGHT, log_odds, merge_probabilities, merge_weights


@pytest.mark.parametrize("seed", range(6))
def test_edges_against_a_plain_list(seed):
    """Random additions under every strategy: order, first direction, lookups, counts and merged values are those of a list worked by the rules."""
    r = random.Random(seed)
    m, rows = Matching(), []
    for _ in range(150):
        u, v = r.randrange(7), r.choice([None, *range(7)])
        faults, weight, p = set(r.sample(range(9), r.randint(0, 2))), r.choice([None, r.uniform(-4, 9)]), r.choice([None, r.random()])
        strategy = r.choice(["disallow", "independent", "smallest-weight", "keep-original", "replace"])
        given = {} if weight is None else {"weight": weight}
        add = (lambda: m.add_boundary_edge(u, faults, error_probability=p, merge_strategy=strategy, **given)) if v is None else (lambda: m.add_edge(u, v, faults, error_probability=p, merge_strategy=strategy, **given))  # noqa: B023
        w, p = 1.0 if weight is None else weight, -1.0 if p is None else p
        old = next((x for x in rows if {x[0], x[1]} == {u, v}), None)
        if old is None:
            rows.append([u, v, faults, w, p])
        elif strategy == "disallow":
            with pytest.raises(ValueError):
                add()
            continue
        elif strategy == "independent":
            tanh = math.tanh(old[3] / 2) * math.tanh(w / 2)
            old[3] = math.log1p(tanh) - math.log1p(-tanh)
            old[4] = old[4] * (1 - p) + p * (1 - old[4]) if min(old[4], p) >= 0 else -1.0
        elif strategy == "replace" or strategy == "smallest-weight" and w < old[3]:
            old[2:] = [faults, w, p]
        add()
    got = [(u, v, d["fault_ids"], d["weight"], d["error_probability"]) for u, v, d in m.edges()]
    assert [x[:3] for x in got] == [tuple(x[:3]) for x in rows]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in rows], atol=1e-6)
    assert (m.num_edges, m.num_nodes) == (len(rows), 1 + max(max(x[0], x[1] or 0) for x in rows))
    assert m.num_fault_ids == 1 + max((f for x in rows for f in x[2]), default=-1)
    for a in range(8):
        own = [x for x in got if x[0] == a and x[1] is None]
        assert m.has_boundary_edge(a) == bool(own) and (not own or m.get_boundary_edge_data(a)["weight"] == own[0][3])
        for b in range(8):
            own = [x for x in got if x[1] is not None and {x[0], x[1]} == {a, b}]
            assert m.has_edge(a, b) == bool(own)
            if own:
                assert m.get_edge_data(a, b) == {"fault_ids": own[0][2], "weight": own[0][3], "error_probability": own[0][4]}
            else:
                with pytest.raises(ValueError):
                    m.get_edge_data(a, b)


def test_merge_formula_is_the_probability_of_one_of_two():
    for p in (0.01, 0.3, 0.7):
        for q in (0.02, 0.5, 0.9):
            assert math.isclose(merge_weights(log_odds(p), log_odds(q)), log_odds(merge_probabilities(p, q)), abs_tol=1e-9)
    assert merge_probabilities(0.1, -1) == -1


@pytest.mark.parametrize("over", [0, 1, 10**9])
@pytest.mark.parametrize("sign", [1, -1])
def test_too_heavy_edges_are_left_out_with_a_warning(over, sign):
    m = Matching()
    weight = sign * (MAX_WEIGHT + over)
    for add in (lambda: m.add_edge(1, 2, weight=weight), lambda: m.add_boundary_edge(3, weight=weight)):
        with pytest.warns(UserWarning) if over else contextlib.nullcontext():
            add()
    assert m.num_edges == (0 if over else 2)


def test_ids():
    m = Matching()
    for u, v in ((-1, 0), (0, -1), (-3, -3)):
        with pytest.raises(ValueError):
            m.add_edge(u, v)
    with pytest.raises(ValueError):
        m.add_boundary_edge(-1)
    with pytest.raises(ValueError):
        m.add_edge(0, 1, fault_ids=2, qubit_id=2)
    for k, (given, want) in enumerate(((dict(qubit_id={4, 5}), {4, 5}), (dict(fault_ids=-1), set()), (dict(qubit_id=3), {3}), (dict(fault_ids=[7, 7]), {7}), ({}, set()))):
        m.add_edge(k, k + 1, **given)
        assert m.edges()[-1][2]["fault_ids"] == want


def test_boundary_and_fault_id_counts():
    m = Matching()
    m.add_edge(0, 1, fault_ids=3)
    assert m.num_fault_ids == 4
    m.ensure_num_fault_ids(2)
    assert m.num_fault_ids == 4
    m.ensure_num_fault_ids(9)
    assert m.num_fault_ids == 9
    m.set_boundary_nodes({1, 6})
    assert (m.boundary, m.num_nodes, m.num_detectors) == ({1, 6}, 7, 5)
    m.set_boundary_nodes({0})
    assert m.boundary == {0} and m.is_boundary_node(0) and not m.is_boundary_node(1)
    assert "6 detectors, 1 boundary node, and 1 edge" in repr(m)


def test_check_matrix():
    m = Matching([[1, 1, 0], [0, 1, 1]])
    assert [(u, v, d["fault_ids"]) for u, v, d in m.edges()] == [(0, 2, {0}), (0, 1, {1}), (1, 2, {2})]
    assert m.boundary == {2}
    m = Matching.from_check_matrix(np.array([[1, 1, 0], [0, 1, 1]]), use_virtual_boundary_node=True)
    assert [(u, v) for u, v, _ in m.edges()] == [(0, None), (0, 1), (1, None)] and m.boundary == set()


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("kind", ["each", "one", "none"])
def test_repetitions_of_random_matrices(seed, kind):
    """Columns again for each repetition, the boundary behind all checks, and time-like edges between a check and itself."""
    r = random.Random(seed)
    checks, times = r.randint(3, 6), r.randint(2, 4)
    pairs = r.sample([(a, b) for a in range(checks) for b in range(a + 1, checks)], 3)
    columns = pairs + [(a,) for a in r.sample(range(checks), 2)]
    weights = [r.random() for _ in columns]
    step = {"each": [r.random() for _ in range(checks)], "one": r.random(), "none": None}[kind]
    h = [[int(a in c) for c in columns] for a in range(checks)]
    m = Matching(h, weights=weights, repetitions=times, timelike_weights=step)
    outer = checks * times
    want = {(c[0] + checks * t, c[1] + checks * t if len(c) == 2 else outer): (w, frozenset({k})) for t in range(times) for k, (c, w) in enumerate(zip(columns, weights))}
    value = lambda a: step[a] if kind == "each" else 1.0 if step is None else step
    want |= {(a + checks * t, a + checks * (t + 1)): (value(a), frozenset()) for t in range(times - 1) for a in range(checks)}
    assert {(u, v): (d["weight"], frozenset(d["fault_ids"])) for u, v, d in m.edges()} == want and m.boundary == {outer}


def test_parallel_columns_and_faults():
    h = [[0, 1, 0, 0], [1, 1, 0, 1], [1, 0, 1, 1]]
    weight = lambda s: {(u, v): d["weight"] for u, v, d in Matching.from_check_matrix(h, weights=[3.0, 1.0, 1.0, 5.0], merge_strategy=s).edges()}[(1, 2)]
    assert weight("smallest-weight") == 3.0 and weight("replace") == 5.0
    m = Matching.from_check_matrix([[1, 1, 0], [0, 1, 1]], faults_matrix=[[1, 1, 0], [0, 1, 0]])
    assert [d["fault_ids"] for _, _, d in m.edges()] == [{0}, {0, 1}, set()]


@pytest.mark.parametrize(
    "arguments",
    [
        dict(check_matrix=[[1, 2]]),
        dict(check_matrix=[[1], [1], [1]]),
        dict(check_matrix=[[1, 1]], weights=[1.0]),
        dict(check_matrix=[[1, 1]], error_probabilities=[0.1]),
        dict(check_matrix=[[1, 1]], faults_matrix=[[1]]),
        dict(check_matrix=[[1, 1]], repetitions=2, timelike_weights=[1.0, 2.0]),
        dict(check_matrix=[[1, 1]], repetitions=2, timelike_weights="a"),
        dict(check_matrix=[[1, 1]], weights=1.0, spacelike_weights=1.0),
        dict(check_matrix=[[1, 1]], repetitions=2, measurement_error_probabilities=0.1, measurement_error_probability=0.1),
        dict(check_matrix=None),
    ],
)
def test_check_matrix_errors(arguments):
    with pytest.raises(ValueError):
        Matching().load_from_check_matrix(**arguments)


class Graph:
    """Stands in for a NetworkX graph."""

    def __init__(self, nodes, edges):
        self._nodes, self._edges = nodes, edges

    def nodes(self, data=True):
        return self._nodes

    def edges(self, data=True):
        return self._edges


class IndexedGraph:
    def __init__(self, nodes, edges):
        self._nodes, self._edges = nodes, edges

    def nodes(self):
        return self._nodes

    def weighted_edge_list(self):
        return self._edges


def test_graph_objects():
    nodes = [(0, {"is_boundary": True}), (1, {}), (2, {})]
    edges = [(0, 1, {"fault_ids": 0, "weight": 1.5, "error_probability": 0.1}), (1, 2, {"qubit_id": {1, 2}})]
    for m in (Matching(Graph(nodes, edges)), Matching.from_rustworkx(IndexedGraph([n[1] for n in nodes], edges))):
        assert m.boundary == {0} and m.num_nodes == 3
        assert m.edges() == [(0, 1, {"fault_ids": {0}, "weight": 1.5, "error_probability": 0.1}), (1, 2, {"fault_ids": {1, 2}, "weight": 1.0, "error_probability": -1.0})]
    assert Matching.from_networkx(Graph(nodes, edges), min_num_fault_ids=8).num_fault_ids == 8
    with pytest.raises(ValueError):
        Matching(Graph(nodes, [(0, 1, {"fault_ids": 0, "qubit_id": 0})]))
    with pytest.raises(TypeError):
        Matching(Graph(nodes, [(0, 1, {"fault_ids": {"a"}})]))
    with pytest.raises(TypeError):
        Matching(Graph(nodes, [(0, 1, {"fault_ids": 1.5})]))
    with pytest.raises(TypeError):
        Matching().load_from_networkx("graph")
    with pytest.raises(TypeError):
        Matching(object())
    with pytest.warns(DeprecationWarning):
        Matching().load_from_retworkx(IndexedGraph([{}, {}], [(0, 1, {})]))
    nodes, edges = Matching([[1]])._export()
    assert nodes == [(0, False), (1, True)] and edges[0][:2] == (0, 1)
    m = Matching()
    m.add_boundary_edge(0)
    assert m._export() == ([(0, False), (1, True)], [(0, 1, {"fault_ids": set(), "weight": 1.0, "error_probability": -1.0})])


def test_drawing_and_random_numbers():
    m = Matching([[1, 1, 0], [0, 1, 1]])
    assert m.draw().startswith("<svg") and m.draw().count("<line") == 3
    set_seed(3)
    a = rand_float(0, 1)
    set_seed(3)
    assert a == rand_float(0, 1) and 0 <= a < 1


def test_dataframes(spark):
    m = Matching([[1, 1, 0], [0, 1, 1]], weights=2.0)
    nodes, edges = m.to_dataframes(spark)
    assert [tuple(r) for r in nodes.orderBy("node").collect()] == [(0, False), (1, False), (2, True)]
    assert [tuple(r) for r in edges.orderBy("seq").collect()] == [(0, 0, 2, [0], 2.0, None), (1, 0, 1, [1], 2.0, None), (2, 1, 2, [2], 2.0, None)]
