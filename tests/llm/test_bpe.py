"""Byte-pair encoding against the tokenizers library, decoding against the text, sections against offsets."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import bpe, token_counts
from sitegauge.llm.bpe_merge import SHORT, Encoder

PATH = bpe.default_vocabulary()
ODD = [
    "", " ", "  ", "a  b", "a   b ", "\n \n x", "x<|endoftext|>y <|endoftext|>", "a\x1cb \x1d c", "don't I'LL we'll", "ſ½² ٣٤",
    "👍🏽 zwj👨‍👩‍👧", "a" * (SHORT * 20), "日本語テキスト" * 30, "\t\tfoo \t bar", "a\u0085b\u200bc", "The same. " * 500,
    "x \u00a0 \u00a0", "a \u00a0 \u00a0 \u00a0 \u00a0 b", "x\u00a0 \u00a0y", "a \n \t  b \n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


@given(st.lists(st.text(st.sampled_from(list(" \n\t'<|>aeostnd1.,!é日😀\u00a0")), max_size=40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_ids_equal_the_library(library, encoder, batch):
    batch = batch + ODD
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(batch)]
    assert found == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_ids_of_mixed_white_space(library, encoder):
    rng = random.Random(11)
    parts = [" ", "\n", "\t", "\u00a0", "\u2003", "  ", "a", "é", "1", ".", "'s", "\r", "\x0b", "\x1c", "\u200b", "\u2028", "\u3000", "日", "\u0085", "<|endoftext|>", "²"]
    batch = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [" \u00a0 \u00a0", "é \u00a0 \u00a0"]
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_bounded(batch)]
    assert found == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_query_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "x"), (0, ODD[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.with_digests(docs, PATH, keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_and_decode_apart(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert [r.decoded for r in back.orderBy("doc_id").collect()] == [*ODD, ""]


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a b", 1, "z")], "text string, n_tokens int, __ids string")
    assert bpe.with_digests(docs, PATH).first().n_tokens == 2
    assert bpe.with_digests(docs.limit(0), PATH).count() == 0


def test_sections_of_odd_tables(spark):
    rows = [(1, "a b\nc", "mine", 7), (1, "a b\nc", "mine", 7), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section string, n_tokens int")
    got = sorted(tuple(r) for r in token_counts.count_section_tokens(docs, PATH, keep=["doc_id"]).fillna(-1).collect())
    assert got == [(-1, 0, 0, 0, 0, 0), (1, 0, 0, 4, 3, 0), (1, 0, 0, 4, 3, 0), (1, 1, 4, 5, 1, 0), (1, 1, 4, 5, 1, 0)]
    assert token_counts.count_section_tokens(docs.limit(0), PATH).columns == ["doc_id", "text", "section", "start", "end", "n_tokens", "n_crossing"]
    assert token_counts.count_section_tokens(docs.limit(0), PATH).count() == 0


def test_sections_against_offsets(spark, library):
    texts = [*ODD, " \u00a0 \u00a0", "é \u00a0 \u00a0\n\u00a0 \u00a0", "one\ntwo lines\n\n\nend.\n\n", "é\né\n😀\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_counts.count_section_tokens(docs, PATH, keep=["doc_id"]).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        encoded = library.encode(t or "", add_special_tokens=False)
        spans = [(r.start, r.end) for r in own]
        counts, crossing = [0] * len(own), [0] * len(own)
        for a, b in encoded.offsets:
            shares = [max(0, min(b, e) - max(a, s)) for s, e in spans]
            best = shares.index(max(shares))
            counts[best] += 1
            crossing[best] += sum(x > 0 for x in shares) > 1
        assert [r.n_tokens for r in own] == counts and [r.n_crossing for r in own] == crossing
        assert sum(counts) == len(encoded.ids)
        assert "".join((t or "")[a:b] for a, b in spans) == (t or "")
