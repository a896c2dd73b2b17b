"""Operator 8: byte-pair encoding of whole texts, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.bpe_merge import Encoder
from sitegauge.llm.common import append_columns, texts, unused
from sitegauge.sources.tables import read_table


def default_vocabulary() -> str:
    """Where the public byte-level vocabulary of 50,257 ids is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the binary column ``ids``: the text's token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty binary, not null). Special tokens that stand in a text
    become their ids. Texts of any length are encoded whole. Each row is encoded on its own, in tasks,
    without a shuffle; repeated rows give repeated results. The file at ``vocabulary`` must be
    readable on every executor (it is part of their Python installation).
    """

    def start():
        encoder = Encoder(vocabulary)
        return lambda column: [pa.array(encoder.encode_bounded(texts(column)), type=pa.binary())]

    return append_columns(df, [text], f"{ids} binary", start, keep)


def decoded(encoder: Encoder, ids: bytes | None) -> str:
    """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
    return encoder.decode_bytes(np.frombuffer(ids or b"", dtype="<u4")).decode("utf-8", "replace")


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the string column ``text`` that the binary column ``ids`` stands for.

    Special tokens are kept. Null ids give the empty text.
    """

    def start():
        encoder = Encoder(vocabulary)
        return lambda column: [[decoded(encoder, x) for x in column.to_pylist()]]

    return append_columns(df, [ids], f"{text} string", start, keep)


def round_trip(df: DataFrame, vocabulary: str, text: str, ids: str, back: str, keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass, so that a task needs one Python worker and vocabulary."""

    def start():
        encoder = Encoder(vocabulary)

        def work(column):
            coded = encoder.encode_bounded(texts(column))
            return [pa.array(coded, type=pa.binary()), [decoded(encoder, x) for x in coded]]

        return work

    return append_columns(df, [text], f"{ids} binary, {back} string", start, keep)


def with_digests(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes, decodes and adds n_tokens, ids_sha256 and decoded_sha256, keeping the ``keep`` columns."""
    keep = df.columns if keep is None else keep
    ids, back = unused(keep, "__ids"), unused(keep, "__back")
    both = round_trip(df, vocabulary, text, ids, back, keep)
    new = {
        "n_tokens": (F.octet_length(ids) / 4).cast("long"),
        "ids_sha256": F.sha2(ids, 256),
        "decoded_sha256": F.sha2(F.encode(back, "utf-8"), 256),
    }
    return both.select(*[c for c in keep if c.lower() not in new], *[v.alias(k) for k, v in new.items()])


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return with_digests(read_table(spark, sf_dir, "documents"), default_vocabulary(), keep=["doc_id"])
