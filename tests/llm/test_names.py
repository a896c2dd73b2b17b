"""Tables whose columns have the names that operators use, and what operators leave behind."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitegauge.llm import (
    bpe, decontaminate, embedding_dedup, hard_negatives, language_id, minhash_dedup, quality, secret_scan, sharding, token_counts, toxicity, turn_repair, url_filter,
)

CLASHING = ["Host", "Section", "__in0", "__in0_", "__place", "__bucket", "N_Tokens", "__records", "Score", "__sections", "__key", "__spans", "LANG_pred", "n_Words", "row", "Hash", "__text"]
VOCABULARY = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["the cat sat on the mat and looked at us", "token=abcdef123 le chat est assis", None, "", "the cat sat on the mat and looked at us"] * 8
    own = [F.lit(f"kept {c}").alias(c) for c in CLASHING]
    docs = spark.createDataFrame([(i, t, ["en", "fr", None, "en", "en"][i % 5]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").select("*", *own)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    pages = docs.select("doc_id", F.concat(F.lit("http://a.example.org/es/"), F.col("doc_id").cast("string")).alias("url"), *CLASHING)
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id") % 3).alias("embedding"), (F.col("doc_id") % 2).cast("int").alias("label"), *CLASHING)
    turns = docs.select((F.col("doc_id") % 4).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *CLASHING)
    return docs, labels, pages, vectors, turns, spark.createDataFrame([(1, "cat sat on the")], "item_id long, text string")


def operators(tables):
    docs, labels, pages, vectors, turns, benchmark = tables
    return {
        "toxicity": lambda: toxicity.score_toxicity(docs, labels), "url_filter": lambda: url_filter.judge_urls(pages), "secrets": lambda: secret_scan.find_secrets(docs),
        "redacted": lambda: secret_scan.redact_secrets(docs), "passages": lambda: decontaminate.find_passages(docs, benchmark), "several passes": lambda: decontaminate.find_passages(docs, benchmark, block_bytes=3),
        "shards": lambda: sharding.shuffle_into_shards(docs), "sections": lambda: token_counts.count_section_tokens(docs, VOCABULARY), "quality": lambda: quality.score_quality(docs, labels),
        "bpe": lambda: bpe.with_digests(docs, VOCABULARY), "near texts": lambda: minhash_dedup.near_duplicates(docs), "near vectors": lambda: embedding_dedup.near_vectors(vectors),
        "negatives": lambda: hard_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0), "turns": lambda: turn_repair.repair_turns(turns), "languages": lambda: language_id.with_languages(docs, language_id.fit(docs)),
    }


NEW = {
    "url_filter": {"host"}, "sections": {"section", "n_tokens"}, "bpe": {"n_tokens"}, "passages": {"n_words"}, "several passes": {"n_words"}, "languages": {"lang_pred"},
}
SHORT = {"near texts", "near vectors", "negatives", "turns"}


@pytest.mark.parametrize("name", sorted(NEW.keys() | SHORT | {"toxicity", "secrets", "redacted", "shards", "quality"}))
def test_clashing_columns(spark, tables, tmp_path, name):
    made = operators(tables)[name]()
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    made.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    if name not in SHORT:
        replaced = NEW.get(name, set())
        for c in CLASHING:
            if c.lower() not in replaced:
                assert [r[0] for r in made.select(c).distinct().collect()] == [f"kept {c}"], c


@pytest.mark.parametrize("name,left", [("toxicity", 0), ("passages", 0), ("several passes", 1), ("quality", 0), ("languages", 0), ("shards", 1), ("near texts", 1), ("negatives", 1)])
def test_folders_left(spark, tables, name, left):
    """At most the table that the result reads stays."""
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    operators(tables)[name]().count()
    assert len(set(os.listdir(root)) - before) <= left


def test_pipeline_of_clashing_columns(spark, tables, tmp_path):
    docs, labels, *_, benchmark = tables
    named = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long"))
    for name, df in (("documents", named), ("labels", labels.withColumn("quality", F.lit(1))), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
