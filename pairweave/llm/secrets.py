"""Secret scans with corpus-wide ownership frequency.

Candidates come from byte patterns over whole texts.  Base kinds (assign,
access, hex) stand by themselves.  Provider kinds (the others) are added by the
method: every candidate's value is hashed, the hashes are counted by distinct
repositories and owners over all documents, and a value that ``WIDE`` or more
owners hold is a widely copied example; one held by fewer is owner-specific and,
if its characters are varied enough, live-looking.  Added spans are those that
aren't examples.

Counts go by (hash, owner, repository) first and by hash then, so a value in a
third of all rows is summed before it is shuffled; classes are joined back to
candidates only, the most frequent values dealt to many parts, and rows without candidates take no part.

A null text counts as empty; a null owner or repository is one of its own;
rows are told apart, so repeated rows all stay; spans of equal start go by the
order of ``KINDS``; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, texts
from .skew import salted_join
from .storage import cut

WIDE = 5
LEAST_ENTROPY = 2.5
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Kind, a literal without which it can't match, pattern; the value is group 1.
PROVIDERS = (
    ("github", b"gh", re.compile(rb"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})")),
    ("slack", b"xox", re.compile(rb"(xox[abprs]-[A-Za-z0-9-]{10,})")),
    ("google", b"AIza", re.compile(rb"(AIza[A-Za-z0-9_-]{35})")),
    ("jwt", b"eyJ", re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("pem", b"PRIVATE KEY-----", re.compile(rb"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*)")),
    ("url", b"://", re.compile(rb"://[^\s:/@]++:([^\s:/@]{6,}+)@")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in PROVIDERS))
_KEYWORDS = (b"passw", b"secret", b"token", b"api")


def scan(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind's place in KINDS, start, end, value) in code points, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    for k, (_, literal, pattern) in enumerate(PROVIDERS, 3):
        if literal in text:
            found += [(k, *m.span(1), m[1]) for m in pattern.finditer(text)]
    if found and not text.isascii():
        place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(k, int(place[a]), int(place[b]), v) for k, a, b, v in found]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def entropy(value: bytes) -> float:
    """Bits a character."""
    n = np.bincount(np.frombuffer(value, np.uint8))
    p = n[n > 0] / len(value)
    return float(-(p * np.log2(p)).sum()) if len(value) else 0.0


_SPAN = "struct<kind:int,start:long,end:long,hash:string,varied:boolean>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id, owner, repository and found, an array of spans with value hashes, one row a row of ``docs``."""

    def each(batch: pa.RecordBatch) -> dict:
        rows = [
            [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v).hexdigest()[:32], "varied": entropy(v) >= LEAST_ENTROPY} for k, a, b, v in scan(x)]
            for x in texts(batch.column(3))
        ]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("varied", pa.bool_())]))
        return {"doc_id": batch.column(0), "owner": batch.column(1), "repository": batch.column(2), "found": pa.array(rows, kind)}

    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(own, each, f"doc_id long, owner string, repository string, found array<{_SPAN}>")


def ownership(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """hash, n_rows, n_owners, n_repositories, example: how widely each value is copied."""
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    by_place = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
    total = by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"), F.sum("places").alias("n_repositories"))
    return total.withColumn("example", F.col("n_owners") >= wide)


def secrets(docs: DataFrame, wide: int = WIDE, **columns) -> DataFrame:
    """doc_id and spans: kind, start, end, n_owners, n_repositories, example, live; one row a row of ``docs``."""
    found = cut(candidates(docs, **columns).withColumn("row", F.monotonically_increasing_id()))  # kept, as row ids aren't the same when computed again
    none = F.expr("CAST(array() AS array<struct<start:long,kind:int,end:long,n_owners:long,n_repositories:long,example:boolean,live:boolean>>)")
    single = found.filter(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*")
    joined = salted_join(single, ownership(found, wide).withColumnRenamed("n_rows", "n"), ["hash"], "n", F.col("row"))
    span = F.struct("start", "kind", "end", "n_owners", "n_repositories", "example", (~F.col("example") & F.col("varied")).alias("live"))
    spans = joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.filter(F.size("found") == 0).select("doc_id", none.alias("spans")).unionByName(spans.select("doc_id", "spans"))
    return out.withColumn("spans", F.filter("spans", lambda x: (x["kind"] < 3) | ~x["example"]))


def _text(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["example"])).cast("long").alias("n_examples"),
    )
