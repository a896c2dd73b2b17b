"""Operator 4: benchmark passages in documents, by an FM-index of each training shard."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, scratch, texts, unused, write_out
from sitegauge.llm.fm_index import FMIndex
from sitegauge.sources.tables import read_table

WINDOW = 10
#: UTF-8 bytes of benchmark text that are sent to executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
#: Words of a piece of an item; a longer item is searched for in pieces that overlap.
PIECE_WORDS = 50_000
#: Rows and bytes of text of a shard, which has one index.
SHARD_ROWS, SHARD_BYTES = 10_000, 8 << 20

#: What the names of items with and without an id begin with.
NAMED, NAMELESS = "=", "-"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Bytes of words lower-cased, all others a space. Bytes from 0x80 on are parts of non-ASCII letters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


@dataclass
class Phrases:
    """Distinct windows of a block of items: by length, rows of symbols, and the items of each row.

    Row w of the windows of length n belongs to the items ``owners[n][first[n][w] : first[n][w + 1]]``.
    """

    symbols: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int) -> Phrases:
        out = Phrases(items=sorted({item for item, _ in rows}))
        number = {item: i for i, item in enumerate(out.items)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in rows:
            ids = np.array([out.symbols.setdefault(w, len(out.symbols) + 1) for w in words_of(text)], dtype=np.int32)
            n = min(window, len(ids))
            if n:
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[item]))
        for n, parts in found.items():
            owner = np.repeat([i for _, i in parts], [len(w) for w, _ in parts])
            out.windows[n], which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([which.reshape(-1), owner]), axis=0)
            out.owners[n] = pairs[:, 1]
            out.first[n] = np.searchsorted(pairs[:, 0], np.arange(len(out.windows[n]) + 1))
        return out

    def items_of(self, n: int, row: int) -> list[str]:
        return [self.items[i] for i in self.owners[n][self.first[n][row] : self.first[n][row + 1]].tolist()]


class ShardSearch:
    """Finds the phrases' occurrences in a shard, which is a batch of documents."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.shortest = min(phrases.windows, default=0)

    def __call__(self, batch: list[str]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each document: its number of words, merged [start, end) word spans that are hit, and items."""
        lookup = self.phrases.symbols.get
        counts, parts = [], []
        for t in batch:
            words = words_of(t)
            counts.append(len(words))
            parts += [np.fromiter(map(lookup, words, repeat(0)), dtype=np.int32, count=len(words)), np.zeros(1, dtype=np.int32)]
        spans: list[list[tuple[int, int]]] = [[] for _ in batch]
        items: list[set[str]] = [set() for _ in batch]
        if not self.shortest or not batch:
            return counts, spans, items
        symbols = np.concatenate(parts)
        # Words that no item has, and ends of texts, part the shard into runs. No occurrence reaches over
        # a part, and none fits a run that is shorter than the shortest window: the index holds the rest.
        known = np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = ends - starts >= self.shortest
        starts, ends = starts[long_], ends[long_]
        if not len(starts):
            return counts, spans, items
        lengths = ends - starts + 1  # with the separator that follows
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        source = np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))
        runs = symbols[source]
        runs[first + lengths - 1] = 0
        index = FMIndex(runs, len(self.phrases.symbols))
        present = np.bincount(runs, minlength=len(self.phrases.symbols) + 1) > 0
        begin_of_text = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        covered = np.zeros(len(runs) + 1, dtype=np.int32)
        for n, windows in self.phrases.windows.items():
            possible = np.flatnonzero(present[windows].all(axis=1))  # of words that the shard has
            low, high = index.search(windows[possible])
            many = np.maximum(high - low, 0)
            which = np.repeat(possible, many)
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            at = index.locate(rows)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
            text = np.searchsorted(begin_of_text, source[at], side="right") - 1
            both = np.unique(text.astype(np.int64) * len(windows) + which)
            for t, w in zip((both // len(windows)).tolist(), (both % len(windows)).tolist()):
                items[t].update(self.phrases.items_of(n, w))
        hit = np.concatenate([[0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]])
        edge = np.diff(hit)
        begins, lasts = source[np.flatnonzero(edge == 1)], source[np.flatnonzero(edge == -1) - 1]
        text = np.searchsorted(begin_of_text, begins, side="right") - 1
        base = begin_of_text[text]
        for t, a, b in zip(text.tolist(), (begins - base).tolist(), (lasts - base + 1).tolist()):
            spans[t].append((a, b))
        return counts, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; spans that touch stay apart only if a gap lies between them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(batches, window: int):
    """(i, t): items of more than PIECE_WORDS words in pieces; every window lies whole in one of them."""
    for batch in batches:
        ids, found = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(t)
            for a in range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ():
                ids.append(i)
                found.append(b" ".join(words[a : a + PIECE_WORDS + window - 1]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["i", "t"])


def benchmark_pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Pieces of the items with words; an item is named by its id behind a letter, those without an id by another one."""
    name = F.coalesce(F.concat(F.lit(NAMED), F.col(item).cast("string")), F.lit(NAMELESS))
    own = benchmark.select(name.alias("i"), F.col(text).alias("t")).where("t is not null")
    return own.mapInArrow(partial(pieces, window=window), "i string, t string")


def ids_of(items: set[str]) -> list[str]:
    return [i[1:] for i in sorted(items) if i != NAMELESS]


def as_structs(spans: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"start": a, "end": b} for a, b in s] for s in spans]


def find_passages(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    new: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """``df`` with n_words, hit_spans (merged word spans that occurrences of windows cover) and hit_items.

    Texts and items are lower-cased (A-Z) and cut into words. An item's windows are its runs of ``window``
    words, or all its words if it has fewer. Each slice of an Arrow batch (SHARD_ROWS rows of SHARD_BYTES of
    text) is a training shard that gets its own FM-index; no shuffle of ``df`` takes place. hit_items are the
    ids of items with an occurring window, sorted as strings; words of items without an id are hit, but
    such items aren't listed. Null and empty texts have no words. Documents
    in many copies are searched like others. Columns named like the ``new`` ones are replaced.

    A benchmark of more than ``block_bytes`` is dealt into blocks by hash. Each block is a pass over the texts
    that writes the spans and items of the texts it hits, by their MD5, before the next block is loaded, so that the driver and a task hold
    one block's windows at a time. What the passes found is then joined to the documents: no text is ever written.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]
    with scratch(df.sparkSession):
        cut = benchmark_pieces(benchmark, item, item_text, window)
        total = cut.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        blocks = int(total // block_bytes) + 1
        if blocks == 1:
            return searched(df, cut, text, window, kept, new)[0]
        cut = write_out(cut.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))))
        texts_only = df.select(F.col(text).alias("t")).where("t is not null")
        passes = []
        for k in range(blocks):
            found, phrases = searched(texts_only, cut.where(F.col("k") == k), "t", window, ["t"], ("n", "spans", "items"), listed=False)
            found = found.where("size(spans) > 0").groupBy(F.md5("t").alias("key")).agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
            passes.append(write_out(found))
            phrases.destroy()
        hits = passes[0]
        for more in passes[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row of each pass at most
        hits = write_out(hits, outlive=True)
    key, spans, items = (unused([*df.columns, *new], n) for n in ("__key", "__spans", "__items"))
    known = hits.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    joined = df.withColumn(key, F.md5(text)).join(known, key, "left")

    def start():
        def work(column, spans, items):
            every = [merged([(s["start"], s["end"]) for s in own or ()]) for own in spans.to_pylist()]
            return [[len(words_of(t)) for t in texts(column)], as_structs(every), [ids_of(set(own or ())) for own in items.to_pylist()]]

        return work

    return append_columns(joined, [text, spans, items], outputs_of(new), start, kept, SHARD_ROWS, SHARD_BYTES)


def outputs_of(new: tuple[str, str, str]) -> str:
    return f"{new[0]} long, {new[1]} array<struct<start:long,end:long>>, {new[2]} array<string>"


def searched(df: DataFrame, cut: DataFrame, text: str, window: int, kept: list[str], new: tuple[str, str, str], listed: bool = True) -> tuple[DataFrame, Broadcast]:
    """``df`` with what one block of the benchmark's pieces finds, items by their ids, or by their names if not ``listed``; and the block."""
    rows = cut.collect()  # about block_bytes
    phrases = df.sparkSession.sparkContext.broadcast(Phrases.of(sorted((r["i"], r["t"]) for r in rows), window))

    def start():
        search = ShardSearch(phrases.value)

        def work(column):
            counts, spans, items = search(texts(column))
            return [counts, as_structs(spans), [ids_of(i) if listed else sorted(i) for i in items]]

        return work

    return append_columns(df, [text], outputs_of(new), start, kept, SHARD_ROWS, SHARD_BYTES), phrases


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between the words of a span."""
    places = [m.span() for m in WORD.finditer(text.translate(UPPER))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : places[a][0]])
        end = places[b - 1][1]
    return "".join([*out, text[end:]])


def remove_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with benchmark passages cut out of ``text``; texts without a hit are unchanged, null stays null.

    Other columns keep their names, types and values, whatever they are called.
    """
    new = tuple(unused(df.columns, n) for n in ("__words", "__spans", "__items"))
    found = find_passages(df, benchmark, text, new=new, **options)

    def start():
        def work(column, spans):
            pairs = zip(column.to_pylist(), spans.to_pylist())
            return [[cut_words(t, [(s["start"], s["end"]) for s in found]) if found else t for t, found in pairs]]

        return work

    return append_columns(found, [text, new[1]], f"{text} string", start, df.columns).select(*df.columns)


def op4_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item, d.n, i FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.win = t.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
