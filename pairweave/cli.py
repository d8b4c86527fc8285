"""Command line: predict, count_mistakes and animate over shot files.

Files are read on the driver, as a pipe must be; with ``--spark`` predict and
count_mistakes read, decode and write them as tables, whatever their size.
"""

from __future__ import annotations

import argparse
import sys
import time

from .core.graph import Matching
from .sinks import drawing
from .sinks.shots import encode
from .sources import error_model
from .sources.shots import FORMATS, parse


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("predict", "count_mistakes", "animate"):
        p = commands.add_parser(name)
        p.add_argument("--dem", required=True)
        p.add_argument("--in", dest="in_", default="-")
        p.add_argument("--in_format", default="b8", choices=FORMATS)
        p.add_argument("--in_includes_appended_observables", action="store_true")
        p.add_argument("--enable_correlations", action="store_true")
        if name != "animate":
            p.add_argument("--spark", action="store_true", help="read, decode and write as tables; --in, --obs_in and --out are paths of any file system")
        if name == "count_mistakes":
            p.add_argument("--obs_in")
            p.add_argument("--obs_in_format", default="01", choices=FORMATS)
            p.add_argument("--time", action="store_true")
        p.add_argument("--out", default="-")
        p.add_argument("--out_format", default="01", choices=FORMATS)
    return top


def _bytes(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise ValueError(f"could not open {path}: {e}") from e


def _write(path: str, data: bytes) -> None:
    if path == "-":
        sys.stdout.write(data.decode("latin-1")) if not hasattr(sys.stdout, "buffer") else sys.stdout.buffer.write(data)
        sys.stdout.flush()
    else:
        with open(path, "wb") as f:
            f.write(data)


def run(argv: list[str]) -> None:
    args = _arguments().parse_args(argv)
    model = error_model.read(args.dem)
    graph = Matching.from_detector_error_model(model, enable_correlations=args.enable_correlations)
    own = graph.compiled()
    appended = model.num_observables if args.in_includes_appended_observables else 0
    if getattr(args, "spark", False):
        _run_tables(args, model, graph, appended)
        return
    # dets lines name their observables, so they need no count
    shots = list(parse(_bytes(args.in_), args.in_format, model.num_detectors, appended))
    if args.command == "animate":
        _write(args.out, "\n".join(drawing.frames(graph, shots[0][0] if shots else [])).encode())
        return
    solve = own.decode_correlated if args.enable_correlations else own.decode
    began = time.perf_counter()
    masks = [solve(hits)[0] for hits, _ in shots]
    took = time.perf_counter() - began
    if args.command == "predict":
        _write(args.out, encode(masks, args.out_format, graph.num_fault_ids))
        return
    if args.in_includes_appended_observables:
        actual = [o for _, o in shots]
    elif args.obs_in:
        raw = _bytes(args.obs_in)
        actual = [h + o for h, o in parse(raw, args.obs_in_format, 0 if args.obs_in_format == "dets" else model.num_observables)]
    else:
        raise ValueError("count_mistakes needs --obs_in or --in_includes_appended_observables")
    if len(actual) < len(shots):
        raise ValueError("the observables end before the shots")
    wrong = sum(m != sum(1 << i for i in set(o)) for m, o in zip(masks, actual))
    _write(args.out, f"{wrong} / {len(shots)}\n".encode())
    if args.time:
        print(f"decoded {len(shots)} shots in {took:.3f} s, {1e6 * took / max(1, len(shots)):.1f} us a shot", file=sys.stderr)


def _run_tables(args, model, graph: Matching, appended: int) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.decode import decode
    from .operators.evaluate import summary
    from .sinks.shots import write
    from .sources.shots import read, zip_observables

    if "-" in (args.in_, args.out if args.command == "predict" else "", getattr(args, "obs_in", None)):
        raise ValueError("--spark needs paths, not pipes")
    spark = SparkSession.builder.getOrCreate()
    shots = read(spark, args.in_, args.in_format, model.num_detectors, appended)
    if args.command == "count_mistakes" and args.obs_in and not appended:
        own = read(spark, args.obs_in, args.obs_in_format, 0 if args.obs_in_format == "dets" else model.num_observables)
        shots = zip_observables(shots, own.select("shot", F.concat("hits", "observables").alias("observables")))
    elif args.command == "count_mistakes" and not appended and args.in_format != "dets":
        raise ValueError("count_mistakes needs --obs_in or --in_includes_appended_observables")
    found = decode(shots, graph, ("prediction",), enable_correlations=args.enable_correlations)
    if args.command == "predict":
        write(found, args.out, args.out_format)
        return
    ones = F.filter(F.transform("prediction", lambda x, i: F.when(x == 1, i.cast("long"))), lambda x: x.isNotNull())
    wrong = ones != F.array_sort(F.array_distinct("observables"))
    counted = found.agg(F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("mistakes"), F.count(F.lit(1)).alias("shots"))
    _write(args.out, f"{summary(counted).first().summary}\n".encode())


def main(argv: list[str] | None = None) -> int:
    try:
        run(sys.argv[1:] if argv is None else argv)
    except (ValueError, IndexError) as e:
        print(e, file=sys.stderr)
        return 1
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    return 0
