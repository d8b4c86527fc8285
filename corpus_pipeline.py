"""A corpus pipeline of five operators: each stage takes and gives a documents table.

Every stage's result is written as Parquet in the shared folder and read again
as the next one's input, so a lost executor costs one stage at most.  All but
the last return the columns of documents.  Stages:

* language ID: documents without a letter (``und``: null, empty, digits or
  marks only) go;
* line dedup: later occurrences of three-line windows go from the texts, with
  n_chars counted anew where it changed; a text of which nothing is left goes;
* near-dedup: of each class the row of the least doc_id stays, and of several
  such rows one; rows of equal doc_id are told apart by their texts;
* decontamination: rows of which a twentieth or more are benchmark
  windows' words go;
* byte-level BPE: the ids of each text.

Rows are never dropped for another reason, and each is judged by its own text,
whatever other rows share its doc_id.  Null texts are ``und``; rows of null
doc_id are in near-dedup compared with one another only, and of each of their
classes one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.llm import bpe, decontaminate, language, lines, near_dup
from pairweave.llm.arrow import smaller_batches
from pairweave.llm.registry import VOCABULARY, table
from pairweave.llm.skew import salted_join
from pairweave.llm.storage import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    smaller_batches(spark)
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return language.identify(rows, language.train(docs), keep=("row",)).filter(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    longest = max(docs.columns, key=len)
    n, gone = longest + "_lines", longest + "_gone"
    out = lines.dedup(docs, counts=(n, gone))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter((F.col(gone) == 0) | (F.trim("text") != "")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    smaller_batches(spark)
    longest = max(docs.columns, key=len)
    k, h, copies = longest + "_k", longest + "_h", longest + "_n"
    of = near_dup.grouped(docs)
    rows = of.groupBy("doc_id", "k", "h", "group").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter("group IS NOT NULL").groupBy("group", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "h", "k", "n")).alias("least")).select("least.k", "least.h", "least.n")
    stay = first.unionByName(rows.filter("group IS NULL").select("k", "h", F.lit(1).cast("long").alias("n")))
    keys = near_dup.row_key(F.col("doc_id").cast("long"), F.col("text"))
    keyed = docs.withColumns(dict(zip((k, h), keys)))
    kept = salted_join(keyed, stay.select(F.col("k").alias(k), F.col("h").alias(h), F.col("n").alias(copies), F.col("n").alias("n_")), [k, h], "n_", F.monotonically_increasing_id())
    # rows repeated as they are: one stays
    once = kept.filter(F.col(copies) > 1).dropDuplicates([k, h])
    return kept.filter(F.col(copies) == 1).unionByName(once).select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    smaller_batches(spark)
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    smaller_batches(spark)
    out = bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_documents),
    ("byte-level BPE", encode),
]
#: SQL expresses neither the language model, nor the signatures, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each read again from what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
