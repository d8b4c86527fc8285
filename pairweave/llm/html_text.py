"""Main text of web pages: blocks by structure, boilerplate by a suffix array a host.

``blocks`` cuts a page at block-level tags into blocks of text, each with a
role: ``main`` (in an article or main element), ``drop`` (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, by element, role,
class or id), ``open`` (neither) or ``weak`` (in main or open, in an element whose
name only hints at boilerplate, such as ``related-links``).  Scripts, styles and
other content that isn't shown never become text.  Text outside main drops where
a page has main text.

What is boilerplate besides is decided a host: the words outside main of all its
pages, with and without a landmark, are concatenated, a suffix array over them
brings equal substrings together, and a run of ``RUN`` words in ``SHARE`` of the
host's distinct pages, three at least, is boilerplate.  Covered words go: from
open blocks; from main those that recur in the main text of as many pages, too (a headline
that a menu repeats stays, and so does a passage that only articles share).  A block that runs
cover whole, also those that begin or end beside it, goes whole; a weak block
goes then, or if links hold most of it.  Unique runs stay.

A host of many pages is dealt to several parts, and a part is worked through in
windows of at most ``WINDOW`` words, so none has to fit into memory.  A run in
``SHARE`` of a host's pages is in ``SHARE`` of the pages of some window, so each
window's suffix array gives all candidates; they are then counted exactly over
the whole host.  Parts and windows have no bearing on results.  Only 32-bit
hashes of words outside main are shuffled; texts are not.

Null or empty html gives an empty text.  Pages of equal text outside dropped
blocks count as one, so copies of a page, under other menus too, make no
boilerplate; repeated rows each get their text; pages without a host are a group
of their own; other columns are not read.  A tag whose quotes are never closed
ends at its first ``>``, as do all tags behind it; a ``<`` that begins no tag is text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batched
from .skew import salted_join
from .storage import cut
from .url_lists import host
from .words import shingles

RUN, SHARE, WINDOW, GROUP = 5, 0.3, 400_000, 500
#: Hosts of more than a SPLIT-th of all pages are dealt to parts; so there are at most that many.
SPLIT = 50_000
_SEEN = 200_000
#: Fixed names of HTML: content that isn't markup, that isn't shown as text, elements without an end, blocks.
RAW = frozenset("script style title textarea".split())
UNSEEN = frozenset("noscript template iframe svg object canvas audio video select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside button dialog menu head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What ends an element that was left open: any block a paragraph, an item the one before it.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_KEEP_P = frozenset("td th button caption object".split())
#: Words of a class or an id that name boilerplate, that hint at it, and that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager paywall popup promo promos promotion respond sidebar signup toolbar".split())
HINTS = frozenset("share sharing social related recommended recommendations replies reply subscribe subscription widget widgets skip".split())
BESIDE = frozenset("area articles bar block body bottom box button buttons container content fixed footer form global group header holder icons inner item items left link links list main message mobile outer panel post posts primary right secondary section site slot sticky stories text thread top unit wrap wrapper".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_BEGIN = re.compile(r"</?[A-Za-z]")
_NAMED = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | UNSEEN}


def _tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, lower-case name, attributes) of each tag, going forward only; a name of "" is the text at the end."""
    at = held = 0
    n, last = len(page), page.rfind(">")
    pattern, unclosed = _TAG, set()
    out: list[str] = []
    while True:
        i = page.find("<", at)
        if i < 0:
            break
        to = None
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            to = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            out += (page[held:i], page[i + 9 : n if end < 0 else end])
            at = held = n if end < 0 else end + 3
            continue
        elif i > last:
            at = i + 1
            continue
        elif page[i + 1 : i + 2] in ("!", "?"):
            to = page.find(">", i) + 1
        if to is not None:
            out.append(page[held:i])
            at = held = to
            continue
        m = pattern.match(page, i)
        if not m and pattern is _TAG and _BEGIN.match(page, i):
            m = _PLAIN_TAG.match(page, i)
            if m:
                pattern = _PLAIN_TAG
        if not m:
            at = i + 1
            continue
        out.append(page[held:i])
        at = held = m.end()
        name = m[2].lower()
        if not m[1] and name in _END and name not in unclosed and not m[3].rstrip().endswith("/"):
            end = _END[name].search(page, at)
            if end or name in RAW:
                at = held = end.end() if end else n
                continue
            unclosed.add(name)
        yield "".join(out), m[1], name, m[3]
        out = []
    yield "".join(out) + page[held:], "", "", ""


def _marked(names: str) -> str:
    """``drop`` or ``weak`` if a class or an id names, or hints at, boilerplate: by its last word, or by the first where the others are names of containers."""
    weak = ""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or parts[0] in ("has", "no", "with", "without"):
            continue
        lead = parts[0] if all(x in BESIDE for x in parts[1:]) else ""
        for word in (parts[-1], lead):
            if word in MARKS:
                return "drop"
            if word in HINTS:
                weak = "weak"
    return weak


def _role(name: str, text: str, outer: str) -> str:
    """The role of what is in an element; of ``outer``, the roles form and open or main with a hint (weak-open, weak-main) are resolved by ``blocks``."""
    attrs = {k.lower(): (v or "").strip("\"'") for k, v in _NAMED.findall(text)} if text.strip(" /") else {}
    role, main = attrs.get("role", "").lower(), outer.endswith("main")
    mark = _marked(f"{attrs.get('class', '')} {attrs.get('id', '')}") if "class" in attrs or "id" in attrs else ""
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
    if name in ("body", "html"):
        return outer
    if name in ("article", "main") or role in ("article", "main"):
        return "drop" if hidden or mark == "drop" and name != "main" else "weak-main" if mark and main else "main"
    if hidden or name in DROPPED or role in DROPPED_ROLES or mark == "drop" or name == "header" and not main:
        return "drop"
    if name == "form":
        return "drop" if main else "form"
    if "header" in attrs.get("class", "").lower().split() + [attrs.get("id", "").lower()] and not main:
        return "drop"
    return "weak-" + outer if mark and outer in ("main", "open") else outer


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of each block in page order; role is main, weak, open or drop."""
    found: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []  # name, role
    there: Counter[str] = Counter()
    held: list[tuple[str, str, bool]] = []  # role, text, whether in a link
    role, links = "open", 0

    def flush() -> None:
        for own in dict.fromkeys(r for r, _, _ in held):
            text = " ".join(entities.unescape("".join(t for r, t, _ in held if r == own)).split())
            if text:
                linked = sum(len(t.strip()) for r, t, k in held if r == own and k)
                found.append((own, text, linked / len(text)))
        held.clear()

    def close(k: int) -> None:
        nonlocal role, links
        for name, _ in stack[k:]:
            there[name] -= 1
        links = there["a"]
        del stack[k:]
        role = stack[-1][1] if stack else "open"

    def end(names, until) -> None:
        k = len(stack) - 1
        while k >= 0 and stack[k][0] not in names and stack[k][0] not in until:
            k -= 1
        if k >= 0 and stack[k][0] in names:
            close(k)

    for text, slash, name, rest in _tags(page):
        if text:
            held.append((role, text, links > 0))
        if not name:
            break
        if name == "br":
            held.append((role, " ", False))
        if name in BLOCK:
            flush()
        if slash:
            if there[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if name in BLOCK and there["p"] > 0:
            end(("p",), _KEEP_P)
        if name in _ENDS and any(there[x] > 0 for x in _ENDS[name][0]):
            end(*_ENDS[name])
        role = "drop" if role == "drop" else _role(name, rest, role)
        stack.append((name, role))
        there[name] += 1
        links = there["a"]
    flush()
    main = any(r.endswith("main") for r, _, _ in found)
    wrapped = not main and not any(r.endswith("open") for r, _, _ in found)  # a page that is a form as a whole
    out = []
    for r, text, linked in found:
        if r == "form" and wrapped:
            r = "open"
        if r.startswith("weak-"):
            r = "drop" if linked >= 0.5 or main != r.endswith("main") else "weak"
        out.append((r if r in ("main", "weak") or r == "open" and not main else "drop", text))
    return out


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and the ranks by their first 1, 2, 4, ... items."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < n and n:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, 2 * k
        levels.append(rank)
        if rank[order[-1]] == n - 1:
            break
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many items each suffix shares with the one before it in order (0 for the first)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, bool) if n else np.zeros(0, bool)
        same[ok] = levels[j][a[ok]] == levels[j][b[ok]]
        out[1:][same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    return out


def repeated(streams: list[np.ndarray], run: int = RUN, share: float = SHARE) -> np.ndarray:
    """Hashes (sorted) of the runs that occur in ``share`` or more of the streams of word hashes; 0 is a gap that no run crosses."""
    flat = np.concatenate([np.concatenate([s, [0]]) for s in streams]).astype(np.int64) if streams else np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    gap = np.flatnonzero(flat == 0)
    apart = flat.copy()
    apart[gap] = -1 - np.arange(len(gap))
    order, levels = suffix_array(apart)
    group = np.cumsum(common_prefixes(order, levels) < run) - 1
    pairs = np.unique(group * len(streams) + page[order])
    pages = np.bincount(pairs // max(1, len(streams)), minlength=group[-1] + 1 if len(group) else 0)
    head = order[np.flatnonzero(np.diff(group, prepend=-1))]
    room = np.diff(np.searchsorted(gap, np.stack([head, head + run]), side="left"), axis=0)[0] == 0 if len(head) else np.zeros(0, bool)
    head = head[room & (pages >= share * len(streams)) & (head + run <= len(flat))]
    keys = shingles(np.concatenate([flat, np.zeros(run, np.int64)]).astype(np.uint64), run)
    return np.unique(keys[head].astype(np.int64))


def _covered(starts: np.ndarray, run: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in runs that start at ``starts``."""
    cover = np.zeros(n + run + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return np.cumsum(cover)[:n] > 0


def _keys(words: list[str], known: dict[str, int]) -> np.ndarray:
    """32-bit hashes of words, alike in every process, never 0."""
    if len(known) > _SEEN:
        known.clear()
    return np.array([known.get(x) or known.setdefault(x, zlib.crc32(x.encode("utf-8", "replace")) or 1) for x in words], np.uint64)


def _segments(found: list[tuple[str, str]]) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """Stretches of blocks in main text (True), and outside it."""
    for main, own in groupby(found, lambda x: x[0] == "main"):
        yield main, list(own)


def _outside(found: list[tuple[str, str]], known: dict[str, int]) -> np.ndarray:
    """The hashes of the words outside main, with a gap where main text lies between."""
    parts = [_keys([w for _, t in own for w in t.split()], known) for main, own in _segments(found) if not main]
    return np.concatenate([x for p in parts for x in (np.zeros(1, np.uint64), p)][1:]) if parts else np.zeros(0, np.uint64)


def _runs(words: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where a run starts that is in ``among`` (sorted hashes)."""
    return np.flatnonzero(np.isin(shingles(words, RUN).astype(np.int64), among)) if len(among) and len(words) >= RUN else np.zeros(0, np.int64)


def _text(found: list[tuple[str, str]], outside: np.ndarray, inside: np.ndarray, known: dict[str, int]) -> str:
    """The text of a page's blocks, where runs ``outside`` main and ``inside`` it (sorted hashes) are boilerplate."""
    if not len(outside):
        return "\n".join(t for r, t in found if r != "drop")
    keep = []
    for main, own in _segments(found):
        split = [t.split() for _, t in own]
        block = np.repeat(np.arange(len(own)), [len(x) for x in split])
        at = _runs(_keys([w for x in split for w in x], known), inside if main else outside)
        anywhere = _covered(at, RUN, len(block))
        within = _covered(at[block[at] == block[at + RUN - 1]], RUN, len(block))
        first = 0
        for (role, text), words in zip(own, split):
            place = slice(first, first + len(words))
            first += len(words)
            if role == "drop" or anywhere[place].all():
                continue
            gone = within[place]
            keep.append(" ".join(x for x, g in zip(words, gone) if not g) if role != "weak" and gone.any() else text)
    return "\n".join(keep)


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _parse(page: bytes | None) -> list[tuple[str, str]]:
    return blocks((page or b"").decode("utf-8", "replace"))


def _vote(found: list[tuple[str, str]]) -> int:
    return _hash("\n".join(t for r, t in found if r != "drop").encode("utf-8", "replace"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, parts, vote and words of each page; of equal ones in a task one, as far as memory of them goes."""
    known: dict[str, int] = {}
    seen: set[tuple] = set()
    for batch in batches:
        at, votes, words = [], [], []
        for k, (host_, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            found = _parse(page)
            vote, own = _vote(found), _outside(found, known).astype("<u4").tobytes()
            key = (host_, vote, _hash(own))
            if key not in seen:
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(key)
                at.append(k), votes.append(vote), words.append(own)
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(votes, pa.int64()), pa.array(words, pa.binary())], names=["host", "parts", "vote", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host and run: what a window's suffix array finds often enough to be often enough in the host; the first page of a vote counts."""
    held: list[np.ndarray] = []
    key, vote, size = None, None, 0

    def done() -> pa.RecordBatch:
        runs = repeated(held)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(runs), pa.string()), pa.array(runs)], names=["host", "run"])

    for batch in batches:
        for host_, part, vote_, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (host_, part, vote_) == (key and key[0], key and key[1], vote):
                continue
            own = np.frombuffer(words, "<u4")
            if held and ((host_, part) != key or size + len(own) > WINDOW):
                yield done()
                held, size = [], 0
            key, vote = (host_, part), vote_
            held.append(own)
            size += len(own) + 1
    if held:
        yield done()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, vote, outside and inside: which of the host's candidates a page has outside main, and in it."""
    known: dict[str, int] = {}
    for batch in batches:
        votes, outside, inside = [], [], []
        lists = batch.column(2)
        for k, page in enumerate(batch.column(1).to_pylist()):
            found, among = _parse(page), np.sort(lists[k].values.to_numpy())
            got: dict[bool, list] = {True: [], False: []}
            for main, own in _segments(found):
                words = _keys([w for _, t in own for w in t.split()], known)
                at = _runs(words, among)
                got[main].append(shingles(words, RUN).astype(np.int64)[at] if len(at) else np.zeros(0, np.int64))
            votes.append(_vote(found))
            for main, out in ((False, outside), (True, inside)):
                out.append(np.unique(np.concatenate(got[main])) if got[main] else np.zeros(0, np.int64))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.int64()), pa.array(outside, kind), pa.array(inside, kind)], names=["host", "vote", "outside", "inside"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    none = np.zeros(0, np.int64)
    for batch in batches:
        out = []
        for page, outside, inside in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            a, b = (none if x.values is None else np.sort(x.values.to_numpy()) for x in (outside, inside))
            out.append(_text(_parse(page), a, b, known))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def recurring_runs(own: DataFrame, hosts: DataFrame, group: int = GROUP) -> DataFrame:
    """host, n (its pages), outside and inside: the hashes of the runs that are boilerplate there, of hosts that have any."""
    total = hosts.agg(F.sum("n").alias("n")).first().n or 0
    large = hosts.filter(F.col("n") > max(group, total // SPLIT)).select("host", F.ceil(F.col("n") / group).alias("parts"))
    dealt = own.join(F.broadcast(large), "host", "left").select("host", F.coalesce("parts", F.lit(1)).alias("parts"), "html")  # SPLIT rows at most
    streams = batched(dealt, _streams, "host string, parts long, vote long, words binary")
    placed = streams.select("host", F.pmod("vote", "parts").alias("part"), "vote", "words").repartition("host", "part").sortWithinPartitions("host", "part", "vote", "words")
    candidates = cut(batched(placed, _windows, "host string, run long").distinct().groupBy("host").agg(F.collect_list("run").alias("runs")))
    if candidates.isEmpty():
        return hosts.limit(0).select("host", "n", *(F.expr("CAST(null AS array<long>)").alias(c) for c in ("outside", "inside")))
    wanted = salted_join(own.select("host", "html"), candidates.join(hosts, "host"), ["host"], "n", F.xxhash64("html")).select("host", "html", "runs")
    seen = cut(batched(wanted, _tally, "host string, vote long, outside array<long>, inside array<long>"))
    pages = seen.groupBy("host").agg(F.countDistinct("vote").alias("pages")).filter("pages >= 3")
    least = pages.select("host", F.greatest(F.lit(3), F.ceil(F.col("pages") * F.lit(SHARE))).alias("least"))

    def often(side: str) -> DataFrame:
        each = seen.select("host", "vote", F.explode(side).alias("run")).distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("k"))
        return each.join(least, "host").filter("k >= least").select("host", "run")

    outside = cut(often("outside"))
    both = often("inside").join(outside, ["host", "run"], "left_semi").groupBy("host").agg(F.collect_list("run").alias("inside"))
    return outside.groupBy("host").agg(F.collect_list("run").alias("outside")).join(both, "host", "left").join(hosts, "host").select("host", "n", "outside", "inside")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """page_id, url and text of every page; ``group`` is about how many pages a part of a large host has."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html")).withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    runs = cut(recurring_runs(own.select("host", "html"), hosts, group))
    met = salted_join(own, runs, ["host"], "n", F.xxhash64("page_id", "url"), "left").select("page_id", "url", "html", "outside", "inside")
    return batched(met, _texts, "page_id long, url string, text string")
