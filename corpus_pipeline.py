"""A filtering pipeline over documents: quality, near duplicates, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what the stage before it kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import bpe, decontaminate, minhash_dedup, quality, secret_scan
from sitegauge.llm.common import delete_folder, scratch, shared_folder, unused, write_out
from sitegauge.sources.tables import read_table


def with_lengths(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` in the given columns, n_chars counted anew where the column is there."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, the operator's threshold deciding.

    Where the labels teach nothing (there are none, or of one kind only), all documents stay.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    if model.network is None:
        return docs
    score = unused(docs.columns, "__score")
    return quality.with_scores(docs, model, score=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest id; of equal ids, of the smallest MD5.

    Rows that link with nothing (without an id, or without words) are kept. An id that stands for several texts
    stands for as many documents; of rows with one id and one text, one stays, the least in order of the
    hash of all its columns.
    """
    key = unused(docs.columns, "__key")
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    groups = minhash_dedup.near_groups(keyed, keep=(key,)).where("group is not null")
    rows = groups.groupBy("group", "doc_id", key).agg(F.count("*").alias("rows"))
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", key)).alias("first")).select("group", "first.*").withColumn("stays", F.lit(True))
    decided = write_out(rows.join(first, ["group", "doc_id", key], "left").select("doc_id", key, "rows", "stays"))
    alone = keyed.join(decided.where("stays is null or rows > 1").select("doc_id", key), ["doc_id", key], "left_anti")
    repeated = keyed.join(decided.where("stays and rows > 1").select("doc_id", key), ["doc_id", key], "left_semi")
    row = F.struct(*docs.columns)
    one = repeated.groupBy("doc_id", key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return alone.select(*docs.columns).unionByName(one.select("row.*"))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark windows cover."""
    return with_lengths(decontaminate.remove_passages(docs, read_table(spark, sf_dir, "benchmark")), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kinds of secrets in their places."""
    return with_lengths(secret_scan.redact_secrets(docs), docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens and digests of the ids and of the decoded text."""
    return bpe.with_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_of_near_duplicates),
    ("benchmark_passages", cut_benchmark_passages),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: Learnt scores, an FM-index and byte-pair merges have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder before the next reads them.

    A stage's intermediate tables, and the rows it has read, are deleted as soon as its own rows are written.
    Null, empty and very long texts and repeated rows pass through every stage as its function states; an
    empty table gives an empty result, and an empty benchmark or no labels change nothing. Other columns of
    documents keep their values, but for those that ``encode_tokens`` adds.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        with scratch(spark):
            docs = write_out(stage(spark, docs, sf_dir), path=path)
        if before:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
