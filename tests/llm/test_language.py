"""Language identification against brute force and on held-out words."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.llm import language


def test_viterbi_by_brute_force(monkeypatch):
    r = np.random.default_rng(0)
    for block in (1, 3, 96):
        monkeypatch.setattr(language, "_BLOCK", block)
        for _ in range(60):
            n, row = int(r.integers(1, 8)), None
            score, row = r.normal(size=(n, 3)) * 3, np.sort(r.integers(0, 2, n))
            cuts = sorted({0, n, *r.integers(0, n + 1, 2).tolist()})
            path = language.Viterbi(2.0)
            for a, b in zip(cuts, cuts[1:]):  # a row may go on over several pieces
                path.add(score[a:b], row[a:b])
            label = np.concatenate([*path.labels()][::-1])
            assert (label == language.viterbi(score, row, 2.0)).all()
            for k in set(row.tolist()):
                at = np.flatnonzero(row == k)
                value = lambda p: sum(score[i, c] for i, c in zip(at, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
                assert np.isclose(max(value(p) for p in itertools.product(range(3), repeat=len(at))), value(label[at]))


LANGUAGES = {"aa": "tha ing ere ond ate the".split(), "bb": "eau oux ille què çon est".split(), "cc": "привет мир как дела это что".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(LANGUAGES[lang]) + r.choice(["", "s", "n"]) for _ in range(30)), lang, 0.5) for i, lang in enumerate(random.Random(3).choices("aa bb cc".split(), k=300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language(spark, labelled):
    model = language.train(labelled)
    assert model.langs == ["aa", "bb", "cc"]
    got = language.identify(labelled, model, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0.9 < r.score <= 1 for r in got)
    mixed = " ".join(LANGUAGES["aa"] * 5) + " " + " ".join(LANGUAGES["cc"] * 9) + " " + " ".join(LANGUAGES["bb"] * 4)
    texts = [None, "", "123 !?", "— … «»", "ing", mixed, "word " * 60_000, "漢字 かな", "ere"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, spans int")
    out = {r.doc_id: r for r in language.identify(df, model, keep=("doc_id",)).collect()}
    assert [out[i].lang_pred for i in range(4)] == ["und"] * 4 and all(out[i].score == 0 and out[i].spans == [] for i in range(4))
    assert [s.lang for s in out[5].spans] == ["aa", "cc", "bb"] and out[5].lang_pred == "cc"
    raw = mixed.encode()
    assert raw[out[5].spans[1].start : out[5].spans[1].end].decode().startswith("привет")
    assert out[4].lang_pred == out[8].lang_pred == "aa" and out[7].lang_pred in model.langs and out[6].lang_pred in model.langs
    assert language.identify(df.limit(0), model).count() == 0
    empty = language.train(labelled.limit(0))
    assert {r.lang_pred for r in language.identify(labelled, empty).collect()} == {"und"}


def test_language_is_learned_from_its_share_only(labelled):
    other = labelled.withColumn("lang", F.when(language.remainder() == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.train(labelled), language.train(other)
    assert a.langs == b.langs and (a.log == b.log).all()
    small = language.train(labelled, rows=50)
    assert small.langs == a.langs and not (small.log == a.log).all()


def test_many_labels():
    score = np.full((500, 200), -5.0, np.float32)
    score[:, 195] = 0
    assert set(language.viterbi(score, np.zeros(500, int)).tolist()) == {195}


def test_code_points():
    text = "aZé漢—x\U0001F600ქกя"
    at, found = language.code_points(np.frombuffer(text.encode(), np.uint8))
    assert "".join(map(chr, found)) == text
    assert language.code_points(np.frombuffer(b"\xff\xf8a\xc3", np.uint8))[1].max() < 0x110000


def test_letters_are_code_points(spark, labelled):
    rows = [(i, "hello world good day " * 3, "en") for i in range(40)] + [(100 + i, "漢字仮名交 文語体字典 " * 3, "zh") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # 14 English letters against six Chinese ones, which have 18 bytes
    got = language.identify(spark.createDataFrame([("hello world good 漢字仮名交字",)], "text string"), model, penalty=1.0).first()
    assert got.lang_pred == "en" and abs(got.score - 14 / 20) < 1e-9


def test_the_share_to_learn_from_is_never_empty(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for rows_, there in ((20_000, 200_000), (20_000, 50_000_000_000), (1, 1 << 62)):
        share = rows.filter(language.taken(F.col("h"), rows_, there)).count() / 200_000
        assert abs(share - rows_ / there) < 0.005
    assert rows.limit(1).select(language.taken(F.lit(0).cast("long"), 20_000, 50_000_000_000).alias("x")).first().x


def test_scores_by_brute_force(labelled):
    """Counts of words and trigrams by hand give the model's log probabilities for words of known buckets."""
    model = language.train(labelled, rows=10**9)
    rows = [r for r in labelled.filter((language.remainder() != 2)).collect()]
    n = {lang: {} for lang in model.langs}
    where = lambda w: language._features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    for r in rows:
        for w in r.text.split():
            _, _, _, _, letters, whole, trigram, _ = where(w)
            assert letters.tolist() == [len(w)]
            for k in [*whole.tolist(), *trigram.tolist()]:
                n[r.lang][k] = n[r.lang].get(k, 0) + 1
    half = language.BUCKETS // 2
    for word in ("tha", "eaus", "привет"):
        _, _, _, _, _, whole, trigram, _ = where(word)
        raw = np.array([[n[lang].get(k, 0) + 0.3 for lang in model.langs] for k in [*trigram.tolist(), *whole.tolist()]])
        total = np.array([[sum(v for k, v in n[lang].items() if (k < half) == low) + 0.3 * half for lang in model.langs] for low in [True] * len(trigram) + [False]])
        want = np.log(raw / total)
        want -= want.max(1, keepdims=True)
        own = model.log[np.concatenate([trigram, whole])]
        assert np.allclose(own, want, atol=1e-4)


def test_a_long_text_takes_bounded_memory():
    r = np.random.default_rng(0)
    model = language.Model([f"l{i}" for i in range(20)], r.integers(0, 9, (language.BUCKETS, 20)).astype(float), np.ones((len(language.SCRIPTS), 20)))
    data = np.frombuffer((b"hello world some words here and there " * 150_000)[: 5 << 20], np.uint8)
    tracemalloc.start()
    row, start, end, label, letters = language.spans(model, data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and start[0] == 0 and letters.sum() == np.count_nonzero(data != 32)
