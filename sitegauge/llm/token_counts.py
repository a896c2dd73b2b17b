"""Operator 6: token counts of sections from one encoding of the whole document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.bpe import default_vocabulary
from sitegauge.llm.bpe_merge import Encoder
from sitegauge.llm.common import append_columns, texts, unused
from sitegauge.sources.tables import read_table

#: A section is a line with the newline that ends it.
LINES = r"[^\n]*\n|[^\n]+\Z"


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens with these byte lengths; a token that holds a part of a character spans all of it."""
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character that each byte is part of
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether the token crosses a boundary.

    ``edges`` are the first characters of the sections, in order. An interval join of the sorted token
    spans with the sorted sections finds the sections in which a token begins and ends. A token that
    crosses goes to the section that holds most of its characters, the earlier one of equals.
    """
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    crossing = first != last
    owner = first.copy()
    for t in np.flatnonzero(crossing):
        bounds = np.concatenate([[starts[t]], edges[first[t] + 1 : last[t] + 1], [ends[t]]])
        owner[t] = first[t] + int(np.argmax(np.diff(bounds)))
    return owner, crossing


def count_section_tokens(
    df: DataFrame, vocabulary: str, text: str = "text", sections: str = LINES, keep: list[str] | None = None
) -> DataFrame:
    """One row per document and section: section, start, end (code points), n_tokens, n_crossing.

    The whole text is encoded once; its tokens are then attributed to sections, the matches of the
    pattern ``sections``, which must cover the text without overlap. The counts of a document's
    sections add up to the document's tokens. A null, empty or sectionless text gives one row: section 0,
    0 to 0, no tokens. Columns of ``keep`` (all by default) are repeated for each section; those named like a new column are replaced.
    """
    pattern = re.compile(sections)

    def start():
        encoder = Encoder(vocabulary)

        def one(t: str, ids: bytes) -> list[tuple[int, int, int, int]]:
            spans = [m.span() for m in pattern.finditer(t) if m.end() > m.start()]
            if not spans:
                return [(0, 0, 0, 0)]
            lengths = encoder.vocab.token_len[np.frombuffer(ids, dtype="<u4")]
            begins, ends = token_spans(t.encode(), lengths)
            owner, crossing = allocate(begins, ends, np.array([a for a, _ in spans]))
            tokens = np.bincount(owner, minlength=len(spans)).tolist()
            crossed = np.bincount(owner, weights=crossing, minlength=len(spans)).astype(int).tolist()
            return [(a, b, n, c) for (a, b), n, c in zip(spans, tokens, crossed)]

        def work(column: pa.Array) -> list:
            batch = texts(column)
            rows = [one(t, ids) for t, ids in zip(batch, encoder.encode_bounded(batch))]
            flat = [x for r in rows for x in r]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            fields = [pa.array(v, type=pa.int64()) for v in zip(*flat)]
            structs = pa.StructArray.from_arrays(fields, names=["start", "end", "n_tokens", "n_crossing"])
            return [pa.ListArray.from_arrays(pa.array(offsets), structs)]

        return work

    new = ["section", "start", "end", "n_tokens", "n_crossing"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    sections_name, one_name = unused(kept, "__sections"), unused(kept, "__section")
    found = append_columns(df, [text], f"{sections_name} array<struct<start:long,end:long,n_tokens:long,n_crossing:long>>", start, kept)
    return found.select(*kept, F.posexplode(sections_name).alias("section", one_name)).select(*kept, "section", f"{one_name}.*")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_section_tokens(read_table(spark, sf_dir, "documents"), default_vocabulary(), keep=["doc_id"])
