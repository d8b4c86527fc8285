"""Error models, correlations, shot files and the command line."""

import math
import sys

import numpy as np
import pytest

from pairweave import Matching
from pairweave.cli import main
from pairweave.core.compiled import Compiled
from pairweave.operators.correlated import implied_rules
from pairweave.sinks import shots as sinks
from pairweave.sources import error_model
from pairweave.sources import shots as sources

THREE = "error(0.1) D0 L0\nerror(0.1) D0 D1 L1\nerror(0.1) D1 L2\n"


def test_grammar():
    m = error_model.parse(
        """
        ERROR[a tag](0.125) D0 D1 L0 ^ D2  # comment
        detector(1, 2, 3) D4
        repeat 3 {
            error(0.25) D0
            shift_detectors(0, 0, 1) 2
            repeat 2 { error(0.5) D1 L3 }
        }
        detector(5, 0, 0) D0
        logical_observable L6
        """
    )
    assert m.errors[0] == (0.125, [((0, 1), (0,)), ((2,), ())])
    assert [(p, parts[0][0]) for p, parts in m.errors[1:]] == [(0.25, (0,)), (0.5, (3,)), (0.5, (3,)), (0.25, (2,)), (0.5, (5,)), (0.5, (5,)), (0.25, (4,)), (0.5, (7,)), (0.5, (7,))]
    assert (m.num_detectors, m.num_observables) == (8, 7)
    assert m.coordinates == {4: (1, 2, 3), 6: (5, 0, 3)}
    with pytest.raises(IndexError):
        error_model.parse("H 0")
    for bad in ("error D0", "error(2) D0", "repeat 2 {", "}", "error(0.1) Q0"):
        with pytest.raises(ValueError):
            error_model.parse(bad)


def test_loading_without_correlations():
    m = Matching.from_detector_error_model("error(0.1) D0 D1\nerror(0.2) D0 D1\nerror(0) D2\nerror(0.1) L0\nerror(0.1) D0 D1 D2\nerror(0.1) D3 ^ D4 D5 L2\ndetector D9")
    assert [(u, v, round(d["error_probability"], 9)) for u, v, d in m.edges()] == [(0, 1, 0.26), (3, None, 0.1), (4, 5, 0.1)]
    assert math.isclose(m.get_edge_data(0, 1)["weight"], math.log(0.74 / 0.26))
    assert (m.num_nodes, m.num_fault_ids) == (10, 3)
    with pytest.raises(ValueError):
        m.decode([0] * 10, enable_correlations=True)
    with pytest.raises(TypeError):
        Matching.from_detector_error_model(3)
    with pytest.raises(ValueError):
        Matching.from_detector_error_model_file("/no/such/file")


@pytest.mark.parametrize("bad", ["error(0.6) D0", "error(0.1) D0 D1 D2", "error(0.1) D0 ^ L0", "error(0.1) L0 ^ D0 D1"])
def test_correlated_loading_checks(bad):
    with pytest.raises(ValueError):
        Matching.from_detector_error_model(bad, enable_correlations=True)


def test_correlated_loading_leaves_out():
    m = Matching.from_detector_error_model("error(0) D0 D1\nerror(0.1) L0\nerror(0.1) D1 D0", enable_correlations=True)
    assert [(u, v) for u, v, _ in m.edges()] == [(0, 1)]


def test_implied_weights():
    rules = implied_rules([(0.1, [((0, 1), ()), ((2, 3), ())]), (0.2, [((0, 1), ())])])
    (target, w), = rules[0, 1]
    assert target == (2, 3) and math.isclose(w, math.log((1 - 0.1 / 0.26) / (0.1 / 0.26)))
    (target, w), = rules[2, 3]
    assert target == (0, 1) and abs(w) < 1e-9
    own = Compiled(5, [(0, 1, (), 1.0), (2, 3, (), 1.0), (4, None, (), 1.0)], rules={(0, 1): [((2, 3), 5.0), ((4, -1), 7.0)]})
    assert own.rules == {(0, 1): [((2, 3), 10), ((4, -1), 14)]}


def test_rules_need_targets_of_equal_sign():
    with pytest.raises(ValueError, match="isn't an edge"):
        Compiled(4, [(0, 1, (), 1.0)], rules={(0, 1): [((2, 3), 0.5)]})
    with pytest.raises(ValueError, match="sign"):
        Compiled(4, [(0, 1, (), 1.0), (2, 3, (), -1.0)], rules={(0, 1): [((2, 3), 0.5)]})


def test_correlated_decoding():
    model = "error(0.1) D0 D1\nerror(0.1) D2 D3\nerror(0.3) D0 D1 ^ D2 D3"
    m = Matching.from_detector_error_model(model, enable_correlations=True)
    edges = m.decode_to_edges_array([1, 1, 1, 1], enable_correlations=True)
    assert sorted(map(tuple, edges.tolist())) == [(0, 1), (2, 3)]


def test_reweighting_by_exhaustion():
    """A second pass equals decoding a graph in which the rules of the first pass' edges are applied by hand."""
    model = "error(0.1) D0 D1 L0\nerror(0.05) D1 D2\nerror(0.08) D2 D3 L1\nerror(0.02) D3 L2\nerror(0.03) D0\nerror(0.2) D0 D1 L0 ^ D2 D3 L1\nerror(0.1) D1 D2 ^ D3 L2\nerror(0.04) D0 ^ D2 D3 L1"
    m = Matching.from_detector_error_model(model, enable_correlations=True)
    own = m.compiled()
    for z in range(16):
        hits = [i for i in range(4) if z >> i & 1]
        weights = {k: w for k, (w, _) in own.signed.items()}
        for e in own.decode_edges(hits):
            for target, w in own.rules.get(e, ()):
                weights[target] = min(weights[target], w)
        by_hand = Compiled(4, [(u, None if v < 0 else v, [i for i in range(3) if own.signed[u, v][1] >> i & 1], w // 2) for (u, v), w in weights.items()])
        mask, weight = own.decode_correlated(hits)
        assert weight == by_hand.decode(hits)[1]
        before = own.decode(hits)
        own.decode_correlated(hits)
        assert own.decode(hits) == before  # the graph itself isn't changed


@pytest.mark.parametrize("fmt", sources.FORMATS)
def test_formats_round_trip(fmt):
    rng = np.random.default_rng(0)
    for width in (1, 7, 8, 19, 300):
        masks = [int.from_bytes(rng.bytes(40), "big") & ((1 << width) - 1) if k % 3 else 0 for k in range(64)]
        data = sinks.encode(masks, fmt, width)
        if fmt == "dets":
            got = [sum(1 << x for x in o) for _, o in sources.parse(data, fmt, 0, width)]
        else:
            got = [sum(1 << x for x in h) for h, _ in sources.parse(data, fmt, width)]
        assert got == masks


def test_appended_observables_and_bad_files():
    assert list(sources.parse(b"0110\n1001\n", "01", 3, 1)) == [([1, 2], []), ([0], [0])]
    assert list(sources.parse(b"shot D0 L1 D0\n", "dets", 3, 2)) == [([], [1])]
    for data, fmt in ((b"011", "01"), (b"012\n", "01"), (b"abc", "b8"), (b"x D0\n", "dets"), (b"\x01", "r8"), (b"", "none")):
        with pytest.raises(ValueError):
            list(sources.parse(data, fmt, 9))


def test_predict(tmp_path, capfd):
    (tmp_path / "m.dem").write_text(THREE)
    (tmp_path / "s.dets").write_text("shot\nshot D0\nshot D1\nshot D0 D1\n")
    (tmp_path / "s.b8").write_bytes(bytes([0, 1, 2, 3]))
    for fmt in ("dets", "b8"):
        out = tmp_path / f"out.{fmt}"
        assert main(["predict", "--dem", str(tmp_path / "m.dem"), "--in", str(tmp_path / f"s.{fmt}"), "--in_format", fmt, "--out", str(out), "--out_format", "dets"]) == 0
        assert out.read_text() == "shot\nshot L0\nshot L2\nshot L1\n"
    assert main(["predict", "--dem", str(tmp_path / "none.dem")]) == 1
    assert "could not open" in capfd.readouterr().err
    assert main(["nonsense"]) == 1


def test_count_mistakes(tmp_path):
    (tmp_path / "m.dem").write_text(THREE)
    (tmp_path / "s.dets").write_text("shot L0\nshot D0 L0\nshot D1 L2\nshot D0 D1 L1")
    base = ["count_mistakes", "--dem", str(tmp_path / "m.dem"), "--in", str(tmp_path / "s.dets"), "--in_format", "dets", "--out", str(tmp_path / "out")]
    assert main([*base, "--in_includes_appended_observables"]) == 0
    assert (tmp_path / "out").read_text() == "1 / 4\n"
    (tmp_path / "o.01").write_text("100\n100\n001\n010\n")
    assert main([*base, "--obs_in", str(tmp_path / "o.01")]) == 0
    assert (tmp_path / "out").read_text() == "1 / 4\n"
    (tmp_path / "o.01").write_text("100\n")
    assert main([*base, "--obs_in", str(tmp_path / "o.01")]) == 1
    assert main(base) == 1
    assert main(["animate", *base[1:]]) == 0 and "<svg" in (tmp_path / "out").read_text()


def test_read_as_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    bits = (rng.random((1000, 13)) < 0.2).astype(int)
    want = [[np.flatnonzero(b[:10]).tolist(), np.flatnonzero(b[10:]).tolist()] for b in bits]
    masks = [int("".join(map(str, b[::-1])), 2) for b in bits]
    for fmt in ("01", "hits", "b8"):
        (tmp_path / fmt).write_bytes(sinks.encode(masks, fmt, 13))
        got = sources.read(spark, str(tmp_path / fmt), fmt, 10, 3).orderBy("shot").collect()
        assert [r.shot for r in got] == list(range(1000))
        assert [[r.hits, r.observables] for r in got] == want
    (tmp_path / "d").write_text("".join("shot " + " ".join([*(f"D{x}" for x in h), *(f"L{x}" for x in o)]) + "\n" for h, o in want))
    got = sources.read(spark, str(tmp_path / "d"), "dets", 10, 3)
    assert [[r.hits, r.observables] for r in got.orderBy("shot").collect()] == want
    zipped = sources.zip_observables(got, got.filter("shot < 1000"))
    assert [r.observables for r in zipped.orderBy("shot").collect()] == [o for _, o in want]
    with pytest.raises(Exception, match="end before"):
        sources.zip_observables(got, got.filter("shot < 500")).collect()


if __name__ == "__main__":
    sys.exit(pytest.main([__file__]))


def test_commands_over_tables(spark, tmp_path, capsys):
    """--spark gives what the commands give on the driver, from and to files of every format."""
    r = np.random.default_rng(3)
    (tmp_path / "m.dem").write_text(THREE)
    shots = [([int(i) for i in np.flatnonzero(r.random(2) < 0.4)], [int(j) for j in np.flatnonzero(r.random(3) < 0.4)]) for _ in range(128)]
    masks = [sum(1 << i for i in h) | sum(1 << (2 + j) for j in o) for h, o in shots]
    base = ["--dem", str(tmp_path / "m.dem"), "--in_includes_appended_observables"]
    for fmt in sources.FORMATS:
        path = str(tmp_path / f"in.{fmt}")
        with open(path, "wb") as f:
            f.write(sinks.encode(masks, fmt, 5) if fmt != "dets" else "".join("shot" + "".join(f" D{i}" for i in h) + "".join(f" L{j}" for j in o) + "\n" for h, o in shots).encode())
        both = []
        for more in ([], ["--spark"]):
            assert main(["count_mistakes", *base, "--in", path, "--in_format", fmt, *more]) == 0
            both.append(capsys.readouterr().out)
        assert both[0] == both[1] and both[0].endswith("/ 128\n")
    assert main(["predict", *base, "--in", path, "--in_format", "dets"]) == 0
    said = capsys.readouterr().out
    assert main(["predict", *base, "--in", path, "--in_format", "dets", "--spark", "--out", str(tmp_path / "out")]) == 0
    assert [x.line + "\n" for x in sources.numbered_lines(spark, str(tmp_path / "out")).orderBy("shot").collect()] == said.splitlines(True)
    assert main(["predict", *base, "--spark"]) == 1


QUICK = ["l_arguments", "l_boundary", "l_changed", "l_constructors", "l_count_mistakes", "l_decode", "l_guard", "l_model_edges", "l_model_rules", "l_predict", "q_correlated_edges", "q_dict", "q_negative", "h_bitpack", "e_interval"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_against_duckdb(spark, name):
    import duckdb

    from pairweave.plans import catalog

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("nation", "events", "lineitem", "orders", "customer", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = db.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, (tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall())))
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in sorted(names)) for r in df.collect()))) == want
