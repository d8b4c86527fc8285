"""The pipeline against its stages done by hand, and the registered queries."""

import inspect
import random

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from pairweave.llm import bpe, language, near_dup, registry

from .test_documents import classes_by_hand, contaminated_by_hand, dedup_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of small tables with copies, repeated lines, contamination, odd rows and an extra column of a clashing name."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    text = lambda n, k: "\n".join(" ".join(word() for _ in range(n)) for _ in range(k))
    bench = [(i, text(20, 2)) for i in range(5)]
    rows = [(i, text(12, 6)) for i in range(60)]
    base = text(200, 1)
    rows += [(100 + i, base.replace(" ", f" zz{i} ", 1)) for i in range(5)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + "\nnew words here"), (202, bench[0][1]), (203, text(300, 1) + " " + bench[1][1]), (204, text(3000, 1) + " " + bench[2][1]), (205, None), (206, ""), (207, "12 34"), (208, "a")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "en" if d % 2 else "fr", "s", len(t or ""), 9) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, bench


def test_stages_by_hand(spark, folder):
    path, rows, bench = folder
    docs = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
    left = dedup_by_hand(docs)
    docs = [(d, left[d]) for d, t in docs if left[d] == t or left[d].strip()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    idf = near_dup.inverse_frequencies(near_dup.document_frequencies(df.select(df.text.cast("binary"))))
    of = classes_by_hand(docs, idf)
    docs = [x for x in docs if of[x[0]] == x[0]]
    docs = [x for x, c in zip(docs, contaminated_by_hand([t for _, t in docs], bench)) if not c[4]]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(registry.VOCABULARY)), special_tokens={})
    want = {d: len(own.encode_ordinary(t)) for d, t in docs}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert {100, 204, 208} <= set(want) and not {101, 200, 202, 203, 205, 206, 207} & set(want)


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        assert {r.n_lines for r in out.collect()} == {9}
        assert stage(spark, docs.limit(0), path).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_repeated_rows_leave_one(spark, folder):
    path = folder[0]
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1]


def test_rows_are_judged_by_their_own_texts(spark, folder):
    path, _, bench = folder
    clean = lambda k: " ".join(f"{k}{i}x" for i in "abcdefghijklmnopqrst")
    kind = "doc_id long, text string, n int"
    docs = spark.createDataFrame([(None, bench[0][1], 0), (None, clean("a"), 1), (5, bench[1][1], 2), (5, clean("b"), 3), (6, None, 4)], kind)
    assert sorted(r.n for r in corpus_pipeline.decontaminate_documents(spark, docs, path).collect()) == [1, 3, 4]
    docs = spark.createDataFrame([(1, clean("a"), 0), (1, clean("b"), 1), (2, clean("b"), 2), (None, clean("c"), 3), (None, clean("c"), 4), (None, clean("d"), 5), (1, clean("a"), 6)], kind)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect())
    assert got == [(0, clean("c")), (0, clean("d")), (1, clean("a")), (1, clean("b"))]


def test_registered():
    names = set(registry.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert names | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(registry.SQL) <= names and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for f in registry.QUERIES.values():
        assert list(inspect.signature(f).parameters) == ["spark", "sf_dir"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = db.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, (tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall())))
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in sorted(names)) for r in df.collect()))) == want


def test_language_query_holds_out(spark):
    got = registry.op10_language_id(spark, "/root/testdata/sf0.001").collect()
    import zlib

    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and language.UNKNOWN not in {r.lang_pred for r in held}
