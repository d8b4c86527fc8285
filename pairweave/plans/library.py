"""Queries of the graph object, sources and sinks, with their SQL: built, asked and exported on the driver, compared as tables."""

from __future__ import annotations

import contextlib
import io
import math
import os
import sys
import tempfile
import types
import uuid
import warnings

from pyspark.sql import functions as F

from ..cli import run as command
from ..core.graph import STRATEGIES, Matching
from ..operators.decode import decode
from ..operators.sampling import rand_float, randomize, set_seed
from ..sinks import drawing
from ..sinks.shots import encode
from ..sources import error_model
from ..sources import shots as sources
from . import fixtures as fx
from .register import query


def _rows(spark, sf_dir) -> list:
    return fx.torus(spark, sf_dir).orderBy("seq").collect()  # 55 edges, whatever the scale


def _edges(graph: Matching, how: str) -> list[tuple]:
    """(how, least node, other node or 25, weight, label) of each edge."""
    out = []
    for u, v, d in graph.edges():
        v = 25 if v is None else v
        out.append((how, min(u, v), max(u, v), float(d["weight"]), min(d["fault_ids"])))
    return out


class _Objects:
    """Stands in for graph objects of either kind; ``weighted_edge_list`` is there for the second only."""

    def __init__(self, rows, indexed: bool):
        attrs = lambda r: {"fault_ids": set(r.fault_ids), "weight": r.weight, "error_probability": r.error_probability}
        self._edges = [(r.node1, 25 if r.node2 is None else r.node2, attrs(r)) for r in rows]
        self._nodes = [(i, {"is_boundary": i == 25}) for i in range(26)]
        if indexed:
            self.weighted_edge_list = lambda: self._edges
            self.nodes = lambda: [x for _, x in self._nodes]
        else:
            self.nodes = lambda data=True: self._nodes
            self.edges = lambda data=True: self._edges


def _dense(rows) -> tuple[list, list]:
    """The check matrix and the faults matrix of the torus."""
    return [[int(n in (r.node1, r.node2)) for r in rows] for n in range(25)], [[int(f in r.fault_ids) for r in rows] for f in range(8)]


_HOWS = "('edges'), ('matrix'), ('constructor'), ('virtual'), ('networkx'), ('rustworkx'), ('retworkx'), ('object')"


@query(f"SELECT how, least(node1, coalesce(node2, 25)) AS u, greatest(node1, coalesce(node2, 25)) AS v, CAST(weight AS DOUBLE) AS weight, fault FROM torus, (VALUES {_HOWS}) AS h(how)", fx.SQL_TORUS)
def l_constructors(spark, sf_dir):
    """The torus built in each way."""
    rows = _rows(spark, sf_dir)
    h, f = _dense(rows)
    w = [r.weight for r in rows]
    out = _edges(fx.torus_graph(spark, sf_dir), "edges")
    out += _edges(Matching.from_check_matrix(h, weights=w, faults_matrix=f), "matrix")
    out += _edges(Matching(h, weights=w, faults_matrix=f), "constructor")
    out += _edges(Matching.from_check_matrix(h, weights=w, faults_matrix=f, use_virtual_boundary_node=True), "virtual")
    out += _edges(Matching.from_networkx(_Objects(rows, False)), "networkx") + _edges(Matching.from_rustworkx(_Objects(rows, True)), "rustworkx")
    old = Matching()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        old.load_from_retworkx(_Objects(rows, True))
    out += _edges(old, "retworkx") + _edges(Matching(_Objects(rows, False)), "object")
    return spark.createDataFrame(out, "how string, u long, v long, weight double, fault long")


def _refused(f) -> bool:
    try:
        f()
        return False
    except ValueError:
        return True


@query("""SELECT 'weights' AS what, k, k <> 55 AS refused FROM range(40, 70) AS r(k) UNION ALL SELECT 'error_probabilities', k, k <> 55 FROM range(40, 70) AS r(k)
UNION ALL SELECT 'timelike_weights', k, k <> 25 FROM range(10, 40) AS r(k) UNION ALL SELECT 'ones', k, k > 2 FROM range(1, 8) AS r(k)
UNION ALL SELECT 'value', k, k NOT IN (0, 1) FROM range(0, 6) AS r(k) UNION ALL SELECT 'faults', k, k <> 55 FROM range(50, 60) AS r(k)""")
def l_arguments(spark, sf_dir):
    """Lengths and entries that a check matrix takes."""
    rows = _rows(spark, sf_dir)
    h, _ = _dense(rows)
    build = lambda m=h, **k: lambda: Matching.from_check_matrix(m, **k)
    out = [("weights", k, _refused(build(weights=[1.0] * k))) for k in range(40, 70)]
    out += [("error_probabilities", k, _refused(build(error_probabilities=[0.1] * k))) for k in range(40, 70)]
    out += [("timelike_weights", k, _refused(build(repetitions=2, timelike_weights=[1.0] * k))) for k in range(10, 40)]
    out += [("ones", k, _refused(build([[int(i < k)] for i in range(10)]))) for k in range(1, 8)]
    out += [("value", k, _refused(build([[1, k], [1, 1]]))) for k in range(6)]
    out += [("faults", k, _refused(build(faults_matrix=[[1] * k]))) for k in range(50, 60)]
    return spark.createDataFrame(out, "what string, k long, refused boolean")


@query("SELECT a.n_nationkey AS u, b.n_nationkey AS v, EXISTS (SELECT 1 FROM torus t WHERE least(t.node1, t.node2) = a.n_nationkey AND greatest(t.node1, t.node2) = b.n_nationkey) AS refused FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", fx.SQL_TORUS)
def l_disallow(spark, sf_dir):
    """An edge that is there already is refused."""
    g = fx.torus_graph(spark, sf_dir)
    out = [(u, v, _refused(lambda: g.add_edge(u, v))) for u in range(25) for v in range(u + 1, 25)]  # noqa: B023
    return spark.createDataFrame(out, "u int, v int, refused boolean")


@query("SELECT n_nationkey AS k, sign * n_nationkey * 1000000 AS weight, n_nationkey * 1000000 <= 16777215 AS kept, n_nationkey * 1000000 > 16777215 AS warned FROM nation, (VALUES (1), (-1)) AS s(sign)")
def l_weight_limit(spark, sf_dir):
    """Edges over the limit are left out with a warning."""
    out = []
    for k in range(25):
        for sign in (1, -1):
            g = Matching()
            with warnings.catch_warnings(record=True) as said:
                warnings.simplefilter("always")
                g.add_edge(k, k + 1, weight=sign * k * 1_000_000)
            out.append((k, sign * k * 1_000_000, g.num_edges == 1, len(said) == 1))
    return spark.createDataFrame(out, "k int, weight int, kept boolean, warned boolean")


_NAMES = "names AS (SELECT unnest(['disallow', 'independent', 'smallest-weight', 'keep-original', 'replace']) AS name, true AS known UNION ALL SELECT n_name, false FROM nation)"


@query("SELECT name, NOT known AS refused FROM names", _NAMES)
def l_strategies(spark, sf_dir):
    """Names of merge strategies, among other names."""
    names = [*STRATEGIES, *(r.n_name for r in fx.table(spark, sf_dir, "nation").collect())]
    out = [(x, _refused(lambda: Matching().add_edge(0, 1, merge_strategy=x))) for x in names]  # noqa: B023
    return spark.createDataFrame(out, "name string, refused boolean")


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, n_nationkey % 6 = 0 AS is_boundary, (SELECT count(*) FROM nation WHERE n_nationkey % 6 <> 0) AS num_detectors, (SELECT '<pairweave.Matching object with ' || sum(CASE WHEN n_nationkey % 6 <> 0 THEN 1 ELSE 0 END) || ' detectors, ' || sum(CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END) || ' boundary nodes, and ' || (SELECT count(*) FROM torus) || ' edges>' FROM nation) AS summary FROM nation", fx.SQL_TORUS)
def l_boundary(spark, sf_dir):
    """Boundary nodes, set twice; the second setting counts."""
    g = fx.torus_graph(spark, sf_dir)
    g.set_boundary_nodes({1, 2})
    g.set_boundary_nodes(range(0, 25, 6))
    assert g.boundary == {n for n in range(25) if g.is_boundary_node(n)}
    return spark.createDataFrame([(n, g.is_boundary_node(n), g.num_detectors, repr(g)) for n in range(g.num_nodes)], "node long, is_boundary boolean, num_detectors long, summary string")


@query("SELECT n_nationkey AS least, greatest((SELECT max(fault) + 1 FROM torus), n_nationkey) AS num_fault_ids FROM nation", fx.SQL_TORUS)
def l_fault_ids(spark, sf_dir):
    """At least so many labels."""
    g, out = fx.torus_graph(spark, sf_dir), []
    for k in range(25):
        m = Matching()
        m.add_edge(0, 1, fault_ids=g.num_fault_ids - 1)
        m.ensure_num_fault_ids(k)
        out.append((k, m.num_fault_ids))
    return spark.createDataFrame(out, "least int, num_fault_ids long")


@query("SELECT 'dense' AS what, n, n BETWEEN 20 AND 25 AS taken FROM range(0, 40) AS r(n) UNION ALL SELECT 'packed', n, n BETWEEN 3 AND 4 FROM range(0, 8) AS r(n) UNION ALL SELECT 'batch', n, n BETWEEN 20 AND 25 FROM range(0, 40) AS r(n)")
def l_lengths(spark, sf_dir):
    """Q05: lengths of syndromes, for 20 detectors and five boundary nodes."""
    g = fx.torus_graph(spark, sf_dir)
    g.set_boundary_nodes(range(20, 25))
    out = [("dense", n, not _refused(lambda: g.decode([0] * n))) for n in range(40)]  # noqa: B023
    out += [("packed", n, not _refused(lambda: g.decode_batch([[0] * n], bit_packed_shots=True))) for n in range(8)]  # noqa: B023
    out += [("batch", n, not _refused(lambda: g.decode_batch([[0] * n]))) for n in range(40)]  # noqa: B023
    return spark.createDataFrame(out, "what string, n long, taken boolean")


_BY_NODE = (fx.SQL_TORUS, fx.SQL_DISTANCES.format(graph="torus"))
_BITS = "(SELECT coalesce(bit_xor(CAST(1 AS BIGINT) << CAST(fault AS INT)), 0) FROM torus WHERE ({m} >> CAST(seq AS INT)) & 1 = 1)"


@query(f"SELECT node, CAST(b AS DOUBLE) AS weight, array_to_string(list_transform(range(0, 8), lambda i: CAST((mask >> CAST(i AS INT)) & 1 AS VARCHAR)), '') AS labels FROM (SELECT node, b, {_BITS.format(m='away.m')} AS mask FROM away)", *_BY_NODE)
def l_decode(spark, sf_dir):
    """Q01: one shot at a time on the driver, of one hit each."""
    g = fx.torus_graph(spark, sf_dir)
    found = [(n, *g.decode([int(i == n) for i in range(25)], return_weight=True)) for n in range(25)]
    return spark.createDataFrame([(n, float(w), "".join(map(str, c))) for n, c, w in found], "node long, weight double, labels string")


@query("SELECT node, CAST(b AS DOUBLE) AS before, CAST(least(b, 5) AS DOUBLE) AS after FROM away", *_BY_NODE)
def l_changed(spark, sf_dir):
    """A graph that is changed after it was decoded with."""
    g, out = fx.torus_graph(spark, sf_dir), []
    for n in range(25):
        z = [int(i == n) for i in range(25)]
        other = Matching()
        for u, v, d in g.edges():
            other.add_boundary_edge(u, d["fault_ids"], d["weight"]) if v is None else other.add_edge(u, v, d["fault_ids"], d["weight"])
        before = other.decode(z, return_weight=True)[1]
        other.add_boundary_edge(n, weight=5, merge_strategy="smallest-weight")
        out.append((n, float(before), float(other.decode(z, return_weight=True)[1])))
    return spark.createDataFrame(out, "node long, before double, after double")


@query("SELECT seq, least(node1, coalesce(node2, 25)) AS u, greatest(node1, coalesce(node2, 25)) AS v, coalesce(node2, 25) = 25 AS to_boundary, CAST(weight AS DOUBLE) AS weight FROM torus", fx.SQL_TORUS)
def g_export(spark, sf_dir):
    """Nodes and edges as they are handed to graph packages, the virtual boundary being a further node."""
    nodes, edges = fx.torus_graph(spark, sf_dir)._export()
    outer = {n for n, is_boundary in nodes if is_boundary}
    return spark.createDataFrame([(i, min(u, v), max(u, v), v in outer, float(d["weight"])) for i, (u, v, d) in enumerate(edges)], "seq long, u long, v long, to_boundary boolean, weight double")


@query(f"""SELECT n AS node, (SELECT count(*) FROM torus) AS lines, (SELECT count(*) FROM nation) AS circles, (SELECT count(*) FROM torus WHERE (away.m >> CAST(seq AS INT)) & 1 = 1) AS red, 2 AS frames
FROM nation, (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) JOIN away ON away.node = n WHERE n_nationkey = 0""", *_BY_NODE)
def l_drawing(spark, sf_dir):
    """Pictures of the graph, and of one hit's solution, with an edge's line red where it is chosen."""
    g, out = fx.torus_graph(spark, sf_dir), []
    for n in range(25):
        pictures = drawing.frames(g, [n])
        out.append((n, g.draw().count("<line"), g.draw().count("<circle"), pictures[-1].count('stroke="red"'), len(pictures)))
    return spark.createDataFrame(out, "node long, lines long, circles long, red long, frames int")


# random numbers


@query("""SELECT 'node' AS what, CAST(n_nationkey AS BIGINT) AS id, (SELECT count(*) FROM torus WHERE seq % 3 = 0 AND n_nationkey IN (node1, coalesce(node2, -1))) % 2 AS bit FROM nation
UNION ALL SELECT 'label', f, (SELECT count(*) FROM torus WHERE seq % 3 = 0 AND fault = f) % 2 FROM range(0, 8) AS r(f)""", fx.SQL_TORUS)
def r_certain(spark, sf_dir):
    """Noise of edges that always or never fail."""
    g = Matching()
    for r in _rows(spark, sf_dir):
        p = float(r.seq % 3 == 0)
        g.add_boundary_edge(r.node1, set(r.fault_ids), error_probability=p) if r.node2 is None else g.add_edge(r.node1, r.node2, set(r.fault_ids), error_probability=p)
    faults, syndrome = g.add_noise()
    return spark.createDataFrame([("node", i, int(x)) for i, x in enumerate(syndrome)] + [("label", i, int(x)) for i, x in enumerate(faults)], "what string, id long, bit long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS seed, CAST(n_nationkey AS BIGINT) AS whole, CAST(1 AS BIGINT) AS n_values FROM nation UNION ALL SELECT -1, -1, 25")
def r_seeds(spark, sf_dir):
    """Numbers between a seed and the next one: the same one for the same seed, others after reseeding at random."""
    out = []
    for k in range(25):
        drawn = set()
        for _ in range(3):
            set_seed(k)
            drawn.add(rand_float(k, k + 1))
        out.append((k, math.floor(min(drawn)), len(drawn)))
    fresh = set()
    for _ in range(25):
        randomize()
        fresh.add(rand_float(-1, 0))
    return spark.createDataFrame([*out, (-1, math.floor(min(fresh)), len(fresh))], "seed long, whole long, n_values long")


# models


def _model(spark, sf_dir) -> str:
    """The torus' errors three rounds long: tags, comments, names in any case, shifts and a repeat block; and a detector line a nation."""
    from .catalog import _error_parts

    side = lambda nodes, label: " ".join([*(f"D{x}" for x in nodes), f"L{label}"])
    lines = [f"  ERROR[tag {e}]({p!r}) " + " ^ ".join(side(*x) for x in parts) + "  # a comment" for e, (p, parts) in _error_parts(spark, sf_dir).items()]
    lines += [f"  detector({n % 5}, {n // 5}, 0) D{n}" for n in range(25)]
    return "\n".join(["repeat 3 {", *lines, "  shift_detectors(0, 0, 1) 25", "}", "logical_observable L9"])


@query("""SELECT CAST(round * (SELECT count(DISTINCT err) FROM errors) + dense_rank() OVER (PARTITION BY round ORDER BY err) - 1 AS BIGINT) AS err, p, component, array_to_string(list_filter([node1 + 25 * round, node2 + 25 * round], lambda x: x IS NOT NULL), ',') AS dets, CAST(edge % 8 AS VARCHAR) AS obs
FROM errors, range(0, 3) AS r(round)""", fx.SQL_TORUS, fx.SQL_ERRORS)
def l_model_rows(spark, sf_dir):
    """A model text to rows."""
    rows = error_model.parse(_model(spark, sf_dir)).to_dataframe(spark)
    return rows.select("err", "p", "component", F.array_join("dets", ",").alias("dets"), F.array_join("obs", ",").alias("obs"))


@query("SELECT CAST(n_nationkey + 25 * t AS BIGINT) AS node, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y, CAST(t AS DOUBLE) AS t, CAST(75 AS BIGINT) AS num_detectors, CAST(10 AS BIGINT) AS num_observables FROM nation, range(0, 3) AS r(t)")
def l_model_counts(spark, sf_dir):
    """Declared counts and coordinates."""
    m = error_model.parse(_model(spark, sf_dir))
    return spark.createDataFrame([(n, *c, m.num_detectors, m.num_observables) for n, c in m.coordinates.items()], "node long, x double, y double, t double, num_detectors long, num_observables long")


@contextlib.contextmanager
def _analyser(text: str):
    """Stands in for the external analyser of circuits: every circuit has the given model."""
    module = types.ModuleType("stim")
    model = type("DetectorErrorModel", (), {"__str__": lambda self: text})

    class Circuit:
        def __init__(self, source: str = ""):
            self.source = source

        def detector_error_model(self, *, decompose_errors: bool):
            return model() if decompose_errors and self.source.startswith("# circuit") else None

    module.Circuit, module.DetectorErrorModel = Circuit, model
    before = sys.modules.get("stim")
    sys.modules["stim"] = module
    try:
        yield module
    finally:
        if before is None:
            del sys.modules["stim"]
        else:
            sys.modules["stim"] = before


_EDGES_OF_MODEL = """
merged AS (SELECT edge, (1 - list_reduce(list(1 - 2 * p), lambda a, b: a * b)) / 2 AS p FROM errors GROUP BY edge),
model_edges AS (SELECT least(node1, coalesce(node2, node1)) + 25 * round AS u, CASE WHEN node2 IS NULL THEN -1 ELSE greatest(node1, node2) + 25 * round END AS v, round(ln((1 - p) / p), 6) AS weight, round(p, 9) AS p, seq % 8 AS fault FROM merged JOIN torus ON seq = edge, range(0, 3) AS r(round))"""


@query("SELECT how, u, v, weight, p, fault FROM model_edges, (VALUES ('text'), ('file'), ('constructor'), ('circuit'), ('circuit file'), ('circuit constructor')) AS h(how)", fx.SQL_TORUS, fx.SQL_ERRORS, _EDGES_OF_MODEL)
def l_model_edges(spark, sf_dir):
    """The uncorrelated graph of a model given as text, as a file, and by a stand-in for the analyser of circuits."""
    text = _model(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file, read by the driver
        path = os.path.join(folder, "torus.dem")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        graphs = {"text": Matching.from_detector_error_model(text), "file": Matching.from_detector_error_model_file(path), "constructor": Matching(text)}
        with _analyser(text) as stim:
            with open(os.path.join(folder, "torus.stim"), "w", encoding="utf-8") as f:
                f.write("# circuit")
            graphs["circuit"] = Matching.from_stim_circuit(stim.Circuit("# circuit"))
            graphs["circuit file"] = Matching.from_stim_circuit_file(os.path.join(folder, "torus.stim"))
            graphs["circuit constructor"] = Matching(stim.Circuit("# circuit"))
    out = [(how, min(u, u if v is None else v), -1 if v is None else max(u, v), round(d["weight"], 6), round(d["error_probability"], 9), min(d["fault_ids"])) for how, g in graphs.items() for u, v, d in g.edges()]
    return spark.createDataFrame(out, "how string, u long, v long, weight double, p double, fault long")


def _correlated() -> tuple[str, ...]:
    from .catalog import _CORRELATED, _JOINT

    return fx.SQL_TORUS, fx.SQL_ERRORS, _JOINT, _CORRELATED


def _rules(spark, sf_dir):
    """The rules of a model loaded with correlations, as integers."""
    from .catalog import _correlated_graph

    own = _correlated_graph(spark, sf_dir).compiled()
    edge = {(r.node1, -1) if r.node2 is None else (min(r.node1, r.node2), max(r.node1, r.node2)): r.seq for r in _rows(spark, sf_dir)}
    out = [(edge[a], edge[b], w) for a, rules in own.rules.items() for b, w in rules]
    return spark.createDataFrame(out, "a long, b long, w long")


def _after_correlated(spark, sf_dir):
    """Single hits decoded in two passes, and in one before and after that."""
    from .catalog import _correlated_graph

    g, out = _correlated_graph(spark, sf_dir), []
    for n in range(25):
        z = [int(i == n) for i in range(25)]
        before = g.compiled().decode([n])[1]
        g.decode(z, enable_correlations=True)
        out.append((n, before, g.compiled().decode([n])[1]))
    return spark.createDataFrame(out, "node long, before long, after long")


def register_correlated() -> None:
    """Those whose SQL uses the catalog's."""
    _rules.__name__, _after_correlated.__name__ = "l_model_rules", "l_after_correlated"
    query("SELECT a, b, w FROM rules", *_correlated())(_rules)
    query("SELECT node, CAST(b AS BIGINT) AS before, CAST(b AS BIGINT) AS after FROM away", *_correlated(), fx.SQL_DISTANCES.format(graph="model_torus"))(_after_correlated)


@query("SELECT loaded, asked, asked AND NOT loaded AS refused FROM (VALUES (true), (false)) AS a(loaded), (VALUES (true), (false)) AS b(asked)")
def l_guard(spark, sf_dir):
    """Two passes on a model that was loaded without correlations."""
    text = _model(spark, sf_dir)
    out = []
    for loaded in (True, False):
        g = Matching.from_detector_error_model(text, enable_correlations=loaded)
        out += [(loaded, asked, _refused(lambda: g.decode([0] * 75, enable_correlations=asked))) for asked in (True, False)]  # noqa: B023
    return spark.createDataFrame(out, "loaded boolean, asked boolean, refused boolean")


# infeasible shots


@query("""SELECT user_id, day, CASE WHEN len(hits) % 2 = 0 THEN weight END AS weight, len(hits) % 2 = 0 AS ok FROM shots LEFT JOIN solved USING (user_id, day)""",
    fx.SQL_COMPLETE.replace("WHERE node2 = 25)", "WHERE node2 > 25)"), fx.SQL_SHOTS, fx.sql_match("shots"), recursive=True)
def q_infeasible(spark, sf_dir):
    """Shots of an odd number of hits on a graph without a boundary have null and a status, and those behind them are solved."""
    g = Matching()
    for r in fx.complete(spark, sf_dir).filter("node2 IS NOT NULL").collect():
        g.add_edge(r.node1, r.node2, None, r.weight)
    found = decode(fx.shots(spark, sf_dir), g, ("weight",), on_error="null")
    return found.select("user_id", "day", F.col("weight").cast("long").alias("weight"), (F.col("status") == "ok").alias("ok"))


# shot files


def _folder(spark) -> str:
    from ..storage import shared_folder

    return f"{shared_folder(spark)}/shots-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> None:
    """A small file on whatever file system the folder is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _patterns() -> list[tuple[list[int], list[int]]]:
    """640 shots of 25 detectors and 8 observables: detector i is hit in shot s where (s + 3)(i + 7) % 11 < 3, observable j where (s + 1)(j + 2) % 5 = 0."""
    return [([i for i in range(25) if (s + 3) * (i + 7) % 11 < 3], [j for j in range(8) if (s + 1) * (j + 2) % 5 == 0]) for s in range(640)]


_PATTERNS = """
patterns AS (SELECT s AS shot, array_to_string(list_filter(range(0, 25), lambda i: ((s + 3) * (i + 7)) % 11 < 3), ',') AS hits, array_to_string(list_filter(range(0, 8), lambda j: ((s + 1) * (j + 2)) % 5 = 0), ',') AS observables FROM range(0, 640) AS r(s))"""


def _encoded(fmt: str) -> bytes:
    """The patterns by the formats' definitions, byte by byte, not by this package's writers."""
    bits = [[int(i in h) for i in range(25)] + [int(j in o) for j in range(8)] for h, o in _patterns()]
    if fmt == "01":
        return "".join("".join(map(str, b)) + "\n" for b in bits).encode()
    if fmt == "hits":
        return "".join(",".join(str(i) for i in range(33) if b[i]) + "\n" for b in bits).encode()
    if fmt == "dets":
        return "".join("shot" + "".join(f" D{i}" for i in h) + "".join(f" L{j}" for j in o) + "\n" for h, o in _patterns()).encode()
    if fmt == "b8":
        return b"".join(bytes(sum((b[8 * k + j] if 8 * k + j < 33 else 0) << j for j in range(8)) for k in range(5)) for b in bits)
    if fmt == "ptb64":
        return b"".join(sum(bits[at + k][i] << k for k in range(64)).to_bytes(8, "little") for at in range(0, 640, 64) for i in range(33))
    out = bytearray()
    for b in bits:
        gap = 0
        for one in [*b, 1]:
            gap = gap if one else gap + 1
            if one:
                out += bytes([255] * (gap // 255) + [gap % 255])
                gap = 0
    return bytes(out)


@query("SELECT format, shot, hits, observables FROM patterns, (VALUES ('01'), ('b8'), ('r8'), ('ptb64'), ('hits'), ('dets')) AS f(format)", _PATTERNS)
def h_files(spark, sf_dir):
    """Files of every format, with appended observables, read as tables."""
    folder, out = _folder(spark), None
    for fmt in sources.FORMATS:
        _put(spark, f"{folder}/shots.{fmt}", _encoded(fmt))
        rows = sources.read(spark, f"{folder}/shots.{fmt}", fmt, 25, 8).select(F.lit(fmt).alias("format"), "shot", F.array_join("hits", ",").alias("hits"), F.array_join("observables", ",").alias("observables"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT shot, hits, observables FROM patterns", _PATTERNS)
def h_two_files(spark, sf_dir):
    """Detectors and observables of two files."""
    folder = _folder(spark)
    _put(spark, f"{folder}/shots.hits", "".join(",".join(map(str, h)) + "\n" for h, _ in _patterns()).encode())
    _put(spark, f"{folder}/observables.01", "".join("".join(str(int(j in o)) for j in range(8)) + "\n" for _, o in _patterns()).encode())
    shots = sources.read(spark, f"{folder}/shots.hits", "hits", 25)
    of = sources.read(spark, f"{folder}/observables.01", "01", 8).select("shot", F.col("hits").alias("observables"))
    both = sources.zip_observables(shots, of)
    return both.select("shot", F.array_join("hits", ",").alias("hits"), F.array_join("observables", ",").alias("observables"))


@query("SELECT format, shot, observables FROM patterns, (VALUES ('01'), ('b8'), ('r8'), ('ptb64'), ('hits'), ('dets')) AS f(format)", _PATTERNS)
def s_files(spark, sf_dir):
    """Predictions written in every format, read back by the definitions above."""
    masks, out = [sum(1 << j for j in o) for _, o in _patterns()], []
    for fmt in sources.FORMATS:
        data = encode(masks, fmt, 8)
        bits = lambda x, n: [i for i in range(n) if x >> i & 1]
        if fmt == "b8":
            found = [bits(x, 8) for x in data]
        elif fmt == "ptb64":
            words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]
            found = [[j for j in range(8) if words[8 * (s // 64) + j] >> (s % 64) & 1] for s in range(640)]
        elif fmt == "r8":
            found, at, own = [], 0, []
            for gap in data:
                at += gap
                if at == 8:
                    found.append(own)
                    at, own = 0, []
                else:
                    own.append(at)
                    at += 1
        else:
            lines = data.decode().split("\n")[:-1]
            read = {"01": lambda x: [j for j in range(8) if x[j] == "1"], "hits": lambda x: [int(y) for y in x.split(",") if y], "dets": lambda x: [int(y[1:]) for y in x.split()[1:]]}[fmt]
            found = list(map(read, lines))
        out += [(fmt, s, ",".join(map(str, x))) for s, x in enumerate(found)]
    return spark.createDataFrame(out, "format string, shot long, observables string")


# command line


_MODEL_TORUS = """
merged AS (SELECT edge, (1 - list_reduce(list(1 - 2 * p), lambda a, b: a * b)) / 2 AS p FROM errors GROUP BY edge),
scale AS (SELECT 16777215.0 / max(ln((1 - p) / p)) AS norm FROM merged),
model_torus AS (SELECT t.seq, t.node1, t.node2, t.seq % 8 AS fault, CAST(2 * floor(ln((1 - p) / p) * norm + 0.5) AS BIGINT) AS weight FROM torus t JOIN merged ON edge = seq, scale),
patterns AS (SELECT s AS shot, list_filter(range(0, 25), lambda i: ((s + 3) * (i + 7)) % 11 < 3)[1:8] AS hits FROM range(0, 640) AS r(s))"""
_PREDICTED = (fx.SQL_TORUS, fx.SQL_ERRORS, _MODEL_TORUS, fx.SQL_DISTANCES.format(graph="model_torus"), fx.sql_match("patterns", ("shot",)),
    "predicted AS (SELECT shot, (SELECT coalesce(bit_xor(CAST(1 AS BIGINT) << CAST(fault AS INT)), 0) FROM model_torus WHERE (s.m >> CAST(seq AS INT)) & 1 = 1) AS mask FROM solved s)")


def _command(spark, sf_dir, *arguments: str) -> str:
    """What a command prints for the patterns' first eight hits over the torus' model."""
    from .catalog import _model_text

    with tempfile.TemporaryDirectory() as folder:  # files of the command line are the driver's own
        with open(f"{folder}/torus.dem", "w") as f:
            f.write(_model_text(spark, sf_dir))
        with open(f"{folder}/shots.hits", "w") as f:
            f.write("".join(",".join(map(str, h[:8])) + "\n" for h, _ in _patterns()))
        with open(f"{folder}/observables.dets", "w") as f:
            f.write("".join("shot" + " L1" * (s % 3 == 0) + "\n" for s in range(640)))
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            command([*arguments[:1], "--dem", f"{folder}/torus.dem", "--in", f"{folder}/shots.hits", "--in_format", "hits", *(x.format(folder=folder) for x in arguments[1:])])
        return said.getvalue()


@query("SELECT shot, array_to_string(list_transform(range(0, 8), lambda i: CAST((mask >> CAST(i AS INT)) & 1 AS VARCHAR)), '') AS labels FROM predicted", *_PREDICTED, recursive=True)
def l_predict(spark, sf_dir):
    """Q12, Q15: the command predict."""
    return spark.createDataFrame(list(enumerate(_command(spark, sf_dir, "predict").split("\n")[:-1])), "shot long, labels string")


@query("SELECT format('{} / {}', sum(CASE WHEN mask <> CASE WHEN shot % 3 = 0 THEN 2 ELSE 0 END THEN 1 ELSE 0 END), count(*)) AS summary FROM predicted", *_PREDICTED, recursive=True)
def l_count_mistakes(spark, sf_dir):
    """The command count_mistakes."""
    return spark.createDataFrame([(_command(spark, sf_dir, "count_mistakes", "--obs_in", "{folder}/observables.dets", "--obs_in_format", "dets").strip(),)], "summary string")


@query("SELECT format, shot, labels FROM predicted_text, (VALUES ('01'), ('hits'), ('dets')) AS f(format)", *_PREDICTED,
    "predicted_text AS (SELECT shot, array_to_string(list_transform(list_filter(range(0, 8), lambda i: (mask >> CAST(i AS INT)) & 1 = 1), lambda i: CAST(i AS VARCHAR)), ',') AS labels FROM predicted)", recursive=True)
def l_predict_tables(spark, sf_dir):
    """Predict over tables, from and to the folder that executors share; what it wrote is read again."""
    from .catalog import _model_text

    folder, out = _folder(spark), None
    _put(spark, f"{folder}/torus.dem", _model_text(spark, sf_dir).encode())
    _put(spark, f"{folder}/shots.hits", "".join(",".join(map(str, h[:8])) + "\n" for h, _ in _patterns()).encode())
    with tempfile.TemporaryDirectory() as own:  # the model is the command's own small file
        with open(f"{own}/torus.dem", "w") as f:
            f.write(spark.read.text(f"{folder}/torus.dem", wholetext=True).first().value)
        for fmt in ("01", "hits", "dets"):
            command(["predict", "--spark", "--dem", f"{own}/torus.dem", "--in", f"{folder}/shots.hits", "--in_format", "hits", "--out", f"{folder}/{fmt}", "--out_format", fmt])
    for fmt in ("01", "hits", "dets"):
        rows = sources.read(spark, f"{folder}/{fmt}", fmt, 0 if fmt == "dets" else 8, 0).select(F.lit(fmt).alias("format"), "shot", F.array_join(F.concat("hits", "observables"), ",").alias("labels"))
        out = rows if out is None else out.unionByName(rows)
    return out
