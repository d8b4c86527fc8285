"""Language identification of texts that may mix languages.

Words are runs of ASCII letters and bytes from 0x80.  The scripts of a word, by
ranges of code points, narrow the candidates to the languages that were seen in
them.  Each word gets a score a language: log probabilities of its hashed byte
trigrams (with marks at both ends) and of the word itself.  A Viterbi path over
the words, with one penalty for every change of language, labels spans; the
label with the most letters is the document's, its share of the letters the
score.  A letter is a code point of a Unicode letter category.

Training counts come from labelled rows with crc32(doc_id) mod 4 other than 2,
about ``TRAIN_ROWS`` of them (taken by a 62-bit hash of doc_id, all if there
are fewer); they are summed by executors and reach the driver as
``BUCKETS`` x languages numbers at most.

Null texts and texts without a letter are ``und``, score 0, without spans; so is
every text if there is no labelled row.  Ties go to the language first in
alphabetical order.  Rows are independent, repeated rows get equal results;
a null doc_id is never held out and never learned from.  A long text is worked
through in pieces of at most a megabyte, which keep a bit a word and language and
the best label a word, so paths are exact and memory is some 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batched, map_batches, row_groups, views

TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
PENALTY = 16.0
UNKNOWN = "und"
_SMOOTH = 0.3
_BLOCK = 96
#: Fixed ranges of code points (first, last) by script; the last takes what is in none.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "indic": ((0x980, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF), (0x20000, 0x3FFFF)),
    "other": (),
}
_TOP = 0x110000
_SCRIPT = np.full(_TOP, 1 << (len(SCRIPTS) - 1), np.uint16)
for _i, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        _SCRIPT[_a : _b + 1] = 1 << _i
_ALPHA = np.fromiter((chr(i).isalpha() for i in range(_TOP)), bool, _TOP)
_SCRIPT[~_ALPHA] = 0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where code points begin in UTF-8 bytes, and which they are; what isn't UTF-8 gives some number below 0x110000."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    follow = np.concatenate([data, np.zeros(3, np.uint8)])
    out = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        k = np.flatnonzero(lead >= low)  # longer ones are set again
        value = lead[k] & mask
        for j in range(1, size):
            value = value << 6 | follow[at[k] + j] & 0x3F
        out[k] = value
    return at, np.minimum(out, _TOP - 1)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words' start, end, row, script bits, letters and bucket, then for every byte of a word its trigram's bucket and place of the word."""
    offsets = offsets - offsets[0]
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.flatnonzero(inside)
    low = _FOLD[data].astype(np.uint32)
    before = np.where(first[at], np.uint32(1), low[at - 1])
    after = np.where(last[at], np.uint32(2), low[np.minimum(at + 1, max(len(data) - 1, 0))])
    key = (before << np.uint32(16)) | (low[at] << np.uint32(8)) | after
    trigram = ((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    begin = np.cumsum(first[at]) - 1
    row = np.searchsorted(offsets, start, side="right") - 1
    where = np.flatnonzero(first[at])
    if not len(where):
        none = np.zeros(0, np.int64)
        return start, end, row, np.zeros(0, np.uint16), none, none, trigram, where
    h = np.add.reduceat((key + np.uint32(7)) * ((np.arange(len(at), dtype=np.uint32) - where[begin].astype(np.uint32)) * np.uint32(0x85EBCA6B) + np.uint32(1)), where)
    whole = ((h.astype(np.uint32) * np.uint32(0xC2B2AE35)) >> np.uint32(17)).astype(np.int64) + BUCKETS // 2
    place, point = code_points(data)
    scripts, letters = np.zeros(len(data), np.uint16), np.zeros(len(data), np.int32)
    scripts[place], letters[place] = _SCRIPT[point], _ALPHA[point]
    return start, end, row, np.bitwise_or.reduceat(scripts[at], where), np.add.reduceat(letters[at], where), whole, trigram, where


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows' bytes that end at rows or between words."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + limit, n)
        if to < n:
            edge = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if edge > at:
                to = edge
            else:
                while to < n:
                    gaps = np.flatnonzero(~_LETTER[data[at:to]])
                    if len(gaps):
                        to = at + int(gaps[-1]) + 1
                        break
                    to = min(at + 2 * (to - at), n)
        yield at, to
        at = to


class Model:
    """Log probabilities of buckets, and the languages that each script leaves."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        half = BUCKETS // 2
        self.log = np.empty((BUCKETS, max(1, len(langs))), np.float32)
        for part in (slice(0, half), slice(half, BUCKETS)):
            own = counts[part] + _SMOOTH
            self.log[part] = np.log(own / own.sum(0))
        self.log -= self.log.max(1, keepdims=True)
        self.seen = (scripts >= 0.01 * scripts.sum(0, keepdims=True)) & (scripts > 0)

    def allowed(self, script: np.ndarray) -> np.ndarray:
        """For sets of scripts, the languages seen in any of them; all if that is none."""
        bits = (script[:, None] >> np.arange(len(SCRIPTS))) & 1
        out = (bits @ self.seen.astype(np.int64)) > 0
        out[~out.any(1)] = True
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words' start, end, row, letters and score a language, piece by piece."""
        width = self.log.shape[1]
        for a, b in _pieces(data, offsets, min(1 << 20, max(1 << 14, (1 << 25) // width))):
            start, end, row, script, letters, whole, trigram, where = _features(data[a:b], np.clip(offsets - a, 0, b - a))
            if len(start):
                row = np.searchsorted(offsets, start + a, side="right") - 1
                score = np.add.reduceat(self.log[trigram], where, axis=0) + self.log[whole]
                sets, of = np.unique(script, return_inverse=True)
                score[~self.allowed(sets)[of]] -= 50
                yield start + a, end + a, row, letters, score


class Viterbi:
    """Best paths over words that come in pieces: ``add`` pieces in order, then ``labels`` gives them from the last to the first.

    Rows are sorted, paths of different rows are independent, and one row may go
    on over many pieces.  A word is left by the label it was entered by (``stay``) or by
    the best one before it (``top``).  Blocks of ``_BLOCK`` words are worked
    through side by side: first what each does to every entry label, then from
    the label it is in fact entered by.
    """

    def __init__(self, penalty: float = PENALTY):
        self.penalty = penalty
        self.kept: list[tuple] = []
        self.row, self.state = None, None

    def _blocks(self, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments' first words; blocks' first words, sizes and segments; segments' first blocks and numbers of blocks."""
        new = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        length = np.diff(np.append(new, len(row)))
        blocks = -(-length // _BLOCK)
        head = np.cumsum(blocks) - blocks
        of = np.repeat(np.arange(len(new)), blocks)
        begin = new[of] + (np.arange(len(of)) - head[of]) * _BLOCK
        return new, begin, np.minimum(_BLOCK, new[of] + length[of] - begin), of, head, blocks

    def _steps(self, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of blocks in order of decreasing size: at each place, how many reach it, and their words there."""
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t, side="left"))
            yield k, begin[:k] + t

    def _through(self, score: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(block, label before it, label at its end): the best total."""
        L = score.shape[1]
        out = np.empty((len(begin), L, L))
        most = max(1, (1 << 22) // (L * L))
        for a in range(0, len(begin), most):
            own = slice(a, a + most)
            best = np.where(np.eye(L, dtype=bool), 0.0, -np.inf)[None].repeat(len(begin[own]), 0)
            for k, w in self._steps(begin[own], size[own]):
                v = best[:k]
                best[:k] = np.maximum(v, v.max(2, keepdims=True) - self.penalty) + score[w][:, None, :]
            out[own] = best
        return out

    def add(self, score: np.ndarray, row: np.ndarray) -> None:
        n, L = score.shape
        new, begin, size, of, head, blocks = self._blocks(row)
        entry = np.zeros((len(begin), L))
        goes_on = self.row is not None and row[0] == self.row
        if goes_on:
            entry[0] = self.state
        inner = np.flatnonzero(np.arange(len(of)) != (head + blocks - 1)[of])  # blocks with another behind them, all of _BLOCK words
        if len(inner):
            through = self._through(score, begin[inner], size[inner])
            place = np.full(len(of), -1)
            place[inner] = np.arange(len(inner))
            for t in range(int(blocks.max()) - 1):
                b = head[blocks > t + 1] + t
                entry[b + 1] = (entry[b][:, :, None] + through[place[b]]).max(1)
        order = np.argsort(-size, kind="stable")
        v = entry[order]
        stay, top = np.empty((n, L), bool), np.empty(n, np.int32)
        for k, w in self._steps(begin[order], size[order]):
            own = v[:k]
            best = own.argmax(1)
            switched = own[np.arange(k), best][:, None] - self.penalty
            top[w], stay[w] = best, own >= switched
            v[:k] = np.maximum(own, switched) + score[w]
        left = np.empty_like(v)
        left[order] = v
        left = left[head + blocks - 1]
        self.row, self.state = row[-1], left[-1] - left[-1].max()
        self.kept.append((row.astype(np.int32), np.packbits(stay, axis=1), top, left.argmax(1).astype(np.int32), goes_on))

    def labels(self) -> Iterator[np.ndarray]:
        after = None  # the label before the next piece's first word, if its row goes on from here
        while self.kept:
            row, packed, top, final, goes_on = self.kept.pop()
            L = packed.shape[1] * 8
            stay = np.unpackbits(packed, axis=1).astype(bool)
            new, begin, size, of, head, blocks = self._blocks(row)
            ends = np.empty(len(of), np.int32)
            last = head + blocks - 1
            ends[last] = final
            if after is not None:
                ends[-1] = after
            order = np.argsort(-size, kind="stable")
            if (blocks > 1).any():
                # for every label at a block's end, the label before the block
                enter = np.broadcast_to(np.arange(L, dtype=np.int32), (len(of), L)).copy()
                for k, w in reversed(list(self._steps(begin[order], size[order]))):
                    now = enter[:k]
                    enter[:k] = np.where(np.take_along_axis(stay[w], now, 1), now, top[w][:, None])
                back = np.empty_like(enter)
                back[order] = enter
                for t in range(int(blocks.max()) - 1, 0, -1):
                    b = head[blocks > t] + t
                    ends[b - 1] = back[b, ends[b]]
            label = np.empty(len(row), np.int32)
            now = ends[order].copy()
            for k, w in reversed(list(self._steps(begin[order], size[order]))):
                label[w] = now[:k]
                now[:k] = np.where(stay[w, now[:k]], now[:k], top[w])
            after = (label[0] if stay[0, label[0]] else top[0]) if goes_on else None
            yield label


def viterbi(score: np.ndarray, row: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word; rows are sorted, and paths of different rows are independent."""
    if not len(row):
        return np.zeros(0, np.int32)
    path = Viterbi(penalty)
    path.add(score, row)
    return next(path.labels())


def spans(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and label of the spans of the rows, in order; and letters, (row, language)."""
    n, L = len(offsets) - 1, max(1, len(model.langs))
    path, places = Viterbi(penalty), []
    for start, end, row, letters, score in model.pieces(data, offsets):
        path.add(score, row)
        places.append((start.astype(np.int32), end.astype(np.int32), row.astype(np.int32), letters.astype(np.int32)))
    size = np.zeros(n * L, np.int64)
    found = []
    for label in path.labels():
        start, end, row, letters = places.pop()
        size += np.bincount(row.astype(np.int64) * L + label, letters, n * L).astype(np.int64)
        edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        stop = np.append(edge[1:], len(row)) - 1
        found.append((row[edge], start[edge], end[stop], label[edge]))
    row, start, end, label = (np.concatenate(x) for x in zip(*found[::-1])) if found else (np.zeros(0, np.int32),) * 4
    # spans that a border between pieces has cut
    edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    stop = np.append(edge[1:], len(row)) - 1 if len(row) else edge
    return row[edge], start[edge], end[stop], label[edge], size.reshape(n, L)


def taken(hashed: Column, rows: int, there: int) -> Column:
    """Whether a row is among about ``rows`` of ``there``; of 62 bits, so the share isn't 0 for any corpus."""
    return F.pmod(hashed, F.lit(1 << 62)) < F.lit(max(1, (1 << 62) * rows // there))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows whose remainder isn't 2, on about ``rows`` of them if there are more."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & (remainder() != 2))
    there = own.agg(F.count(F.lit(1)).alias("n")).first().n
    if there > rows:
        own = own.filter(taken(F.xxhash64("doc_id"), rows, there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            at, data = views(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, j in row_groups(at):
                part, own_at = data[at[i] : at[j]], at[i : j + 1] - at[i]
                for a, b in _pieces(part, own_at):
                    start, _, _, script, _, whole, trigram, where = _features(part[a:b], np.clip(own_at - a, 0, b - a))
                    row = np.searchsorted(own_at, start + a, side="right") - 1
                    names = np.array(langs[i:j], object)[row] if len(row) else np.zeros(0, object)
                    sizes = np.diff(np.append(where, len(trigram)))
                    for lang in set(names.tolist()):
                        c = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                        mine = names == lang
                        c[:BUCKETS] += np.bincount(trigram[np.repeat(mine, sizes)], minlength=BUCKETS)
                        c[:BUCKETS] += np.bincount(whole[mine], minlength=BUCKETS)
                        for s in range(len(SCRIPTS)):
                            c[BUCKETS + s] += int(((script[mine] >> s) & 1).sum())
        for lang, c in counts.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "bucket": pa.array(k), "n": pa.array(c[k])})

    got = batched(own.select("text", "lang"), run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(langs))))
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Model(langs, counts[:BUCKETS], counts[BUCKETS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns, then lang_pred, score and spans (start and end in UTF-8 bytes, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def each(batch: pa.RecordBatch) -> dict:
        model = shared.value
        langs = model.langs
        at, data = views(batch.column(0))
        preds, scores, found = [], [], []
        for i, j in row_groups(at):
            own_at = at[i : j + 1] - at[i]
            row, start, end, label, size = spans(model, data[at[i] : at[j]], own_at, penalty)
            first = np.searchsorted(row, np.arange(j - i + 1)).tolist()
            begin, stop, which = (start - own_at[row]).tolist(), (end - own_at[row]).tolist(), label.tolist()
            total, best, most = size.sum(1).tolist(), size.argmax(1).tolist(), size.max(1).tolist()
            for k in range(j - i):
                if not langs or not total[k]:
                    preds.append(UNKNOWN), scores.append(0.0), found.append([])
                else:
                    preds.append(langs[best[k]]), scores.append(most[k] / total[k])
                    found.append([{"start": begin[x], "end": stop[x], "lang": langs[which[x]]} for x in range(first[k], first[k + 1])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        return {c: batch.column(n + 1) for n, c in enumerate(keep)} | {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(found, kind)}

    schema = ", ".join([*kept, "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"])
    return map_batches(docs.select(F.col(text_col).cast("binary"), *keep), each, schema)
