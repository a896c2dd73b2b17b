"""Operator 7: quality by pooled random-indexing word vectors and a two-layer network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, scratch, texts, write_out
from sitegauge.llm.labelled import TRAIN_ROWS, held_out, training_texts
from sitegauge.sources.tables import read_table

#: Dimensions of word vectors; non-zero entries of an index vector; different index vectors, of which a word's hash draws one.
DIM, ENTRIES, INDEXES = 64, 2, 4096
#: Words on each side that count as context, and the weight of the word's own index vector beside theirs.
SIDE, OWN = 2, 1
#: Share of all words from which a word has a context vector: so many are 1 / LEAST_SHARE at most, whatever the corpus.
#: Rarer words, whose few contexts say little, stand for their index vectors, as do those of more than LONGEST letters.
LEAST_SHARE, LONGEST = 1e-5, 40
#: Share of all words at which a word weighs half of a rare one.
HALF = 1e-3
SEED = 20_077
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
THRESHOLD = 0.7
CACHE = 80_000

#: Words and runs of marks; in Java's and Python's expressions the same letters and digits.
PARTS = re.compile(r"\w+|[^\w\s]{1,3}")
JVM_PARTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]{1,3}"
#: What is written beside a word as a word of its own; they hold a space, as no word does.
CAPITALS, DIGITS, MIXED, LONG, AGAIN = SIGNS = (" capitals", " digits", " mixed", " long", " again")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: places and signs of their ENTRIES non-zeros."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (INDEXES, ENTRIES)), rng.choice(np.array([-1, 1]), (INDEXES, ENTRIES))


def index_of(word: str) -> int:
    return zlib.crc32(word.encode()) % INDEXES


def words_of(token: str) -> list[str]:
    """Lower-case words and marks of a token between white space, each with the signs of its shape."""
    out = []
    for part in PARTS.findall(token):
        out.append(part.lower())
        if part[0].isalnum() or part[0] == "_":
            if len(part) > 1 and part.isupper():
                out.append(CAPITALS)
            if part.isdigit():
                out.append(DIGITS)
            elif not part.isalpha():
                out.append(MIXED)
            if len(part) > 20:
                out.append(LONG)
    return out


class Stream:
    """Numbers of a text's words in order: below len(words) for words with a context vector, then index vectors.

    A token's numbers are worked out once and kept in a bounded cache.
    """

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(words)}
        self.again = self.number[AGAIN]
        self.known: dict[str, bytes] = {}

    def number_of(self, word: str) -> int:
        found = self.number.get(word)
        return len(self.number) + index_of(word) if found is None else found

    def numbers(self, token: str) -> bytes:
        mark = token[-1] in ",.;:!?"
        word = token[:-1] if mark else token
        if word.isalpha() and len(word) <= 20 and (len(word) == 1 or not word.isupper()):  # one word without signs
            found = self.number_of(word.lower()).to_bytes(4, "little")
            return found + self.number_of(token[-1]).to_bytes(4, "little") if mark else found
        return b"".join(self.number_of(w).to_bytes(4, "little") for w in words_of(token))

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.split()
        if len(self.known) > CACHE:
            self.known = {}
        for t in set(tokens).difference(self.known):
            self.known[t] = self.numbers(t)
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), dtype="<u4").astype(np.int64)
        again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
        return np.insert(ids, again, self.again) if len(again) else ids


def count_words(docs: DataFrame, text: str = "text") -> tuple[list[str], np.ndarray]:
    """Words of LEAST_SHARE of all words or more, in order, and their shares; the signs of shapes come first.

    All words of all documents are counted, by Spark alone.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(JVM_PARTS), F.lit(0))).alias("word"))
    with scratch(docs.sparkSession):
        counts = write_out(words.groupBy("word").agg(F.count("*").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 1
        some = counts.where((F.col("n") >= LEAST_SHARE * total) & (F.char_length("word") <= LONGEST)).collect()
    known = sorted((r["word"], r["n"]) for r in some)
    return [*SIGNS, *[w for w, _ in known]], np.array([*[0] * len(SIGNS), *[n for _, n in known]]) / total


def add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words up to SIDE places away, and OWN times its own.

    A text ends with numbers below 0, which have neither. Sums are of integers.
    """
    n = len(total) // DIM
    for step in range(-SIDE, SIDE + 1):
        here, there = (ids[-step:], ids[:step]) if step < 0 else (ids[: len(ids) - step], ids[step:])
        both = (here >= 0) & (here < n) & (there >= 0)
        here, there = here[both], index[there[both]]
        for e in range(ENTRIES):
            added = np.bincount(here * DIM + places[there, e], weights=signs[there, e], minlength=len(total))
            np.add(total, added * (OWN if step == 0 else 1), out=total)


def indexes_of(words: list[str]) -> np.ndarray:
    """The index vector of each number of a ``Stream``."""
    return np.array([*map(index_of, words), *range(INDEXES)])


def learn_vectors(docs: DataFrame, text: str = "text") -> tuple[list[str], np.ndarray]:
    """Words and their vectors from all documents; the vectors of numbers beyond the words are index vectors.

    Each task sums up the contexts in its texts in one matrix with a row for each word, of proven size; Spark adds the
    matrices row by row, and so many rows come back. The sums are of integers, so that their order
    doesn't matter. Vectors have unit length, and rare words weigh more than frequent ones.
    """
    words, share = count_words(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def contexts(batches):
        places, signs = index_vectors()
        stream, index = Stream(shared.value), indexes_of(shared.value)
        total = np.zeros(len(shared.value) * DIM)
        gap = np.full(SIDE, -1)

        def add(run):
            add_contexts(total, np.concatenate(run), index, places, signs)

        for batch in batches:
            run, size = [], 0
            for t in texts(batch.column(0)):
                run += [stream(t), gap]
                size += len(run[-2])
                if size > 150_000:
                    add(run)
                    run, size = [], 0
            if run:
                add(run)
        made = total.reshape(-1, DIM).astype(np.int32)
        rows = np.flatnonzero(made.any(axis=1))
        for a in range(0, len(rows), 10_000):
            some = rows[a : a + 10_000]
            values = pa.FixedSizeListArray.from_arrays(pa.array(made[some].reshape(-1)), DIM).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values], names=["word", "sums"])

    parts = docs.select(text).mapInArrow(contexts, "word int, sums array<int>")
    added = F.array(*[F.sum(F.col("sums")[i]).cast("double") for i in range(DIM)])
    out = np.zeros((len(words), DIM))
    for r in parts.groupBy("word").agg(added.alias("sums")).toLocalIterator():
        out[r["word"]] = r["sums"]
    return words, word_vectors(out, share)


def word_vectors(sums: np.ndarray, share: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((INDEXES, DIM))
    np.add.at(own, (np.arange(INDEXES)[:, None], places), signs)
    out = np.concatenate([sums, own])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    weight = np.concatenate([HALF / (HALF + share), np.ones(INDEXES)])
    return (out * weight[:, None]).astype(np.float32)


class Pooling:
    """Pooled vectors of a text, and the logs of its length and variety.

    The word vectors' mean and root mean square by dimension; and the sum of the index vectors of marks and
    signs, by their share of the text, which contexts would blur: they all stand among the same words.
    """

    def __init__(self, words: list[str], vectors: np.ndarray):
        self.vectors, self.squares, self.stream = vectors, vectors**2, Stream(words)
        places, signs = index_vectors()
        marks = [i for i, w in enumerate(words) if not (w[0].isalnum() or w[0] == "_")]
        self.marks = np.zeros((len(words) + INDEXES, DIM), dtype=np.float32)
        for i in marks:
            np.add.at(self.marks[i], places[index_of(words[i])], signs[index_of(words[i])])

    def one(self, text: str) -> np.ndarray:
        used, counts = np.unique(self.stream(text), return_counts=True)
        n = int(counts.sum())
        share = (counts / max(1, n)).astype(np.float32)
        mean, square = share @ self.vectors[used], share @ self.squares[used]
        return np.concatenate([mean, np.sqrt(square), share @ self.marks[used], [np.log1p(n), len(used) / (n + 1)]])

    def __call__(self, batch: list[str]) -> np.ndarray:
        return np.array([self.one(t) for t in batch], dtype=np.float64).reshape(len(batch), 3 * DIM + 2)


class Network:
    """Two layers, tanh and sigmoid, with a temperature that calibrates the logit."""

    def __init__(self, inputs: np.ndarray, labels: np.ndarray):
        self.mean, self.scale = inputs.mean(0), np.maximum(inputs.std(0), 1e-6)
        self.temperature = 1.0
        x = self.scaled(inputs)
        keep = np.arange(len(x)) % 5 != 0  # the fifth part calibrates
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        xs, ys, step = x[keep], labels[keep], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(xs))
            for i in range(0, len(xs), BATCH):
                xb, yb = xs[order[i : i + BATCH]], ys[order[i : i + BATCH]]
                h = np.tanh(xb @ p[0] + p[1])
                gap = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yb) / len(xb)
                back = np.outer(gap, p[2]) * (1 - h * h)
                grads = [xb.T @ back + DECAY * p[0], back.sum(0), h.T @ gap + DECAY * p[2], gap.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        logit, y = self.logit(inputs[~keep]), labels[~keep]

        def loss(t: float) -> float:
            z = logit / t
            return float(np.mean(np.logaddexp(0, z) - y * z))

        self.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss) if len(y) else 1.0

    def scaled(self, inputs: np.ndarray) -> np.ndarray:
        return np.clip((inputs - self.mean) / self.scale, -8, 8)

    def logit(self, inputs: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(inputs) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(inputs) / self.temperature, -40, 40)))


class Quality:
    """Word vectors and the network over pooled vectors; without a network, one score for all texts."""

    def __init__(self, words: list[str], vectors: np.ndarray, network: Network | None, share: float):
        self.words, self.vectors, self.network, self.share = words, vectors, network, share

    def scorer(self):
        pooling = Pooling(self.words, self.vectors)

        def score(batch: list[str]) -> list[float]:
            return self.network(pooling(batch)).tolist() if self.network else [self.share] * len(batch)

        return score


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Quality:
    """Word vectors from all documents, and the network from at most ``rows`` labelled ones.

    Where the labels are all of one kind there is nothing to tell apart, and no network: the share of label 1
    (a half without labels) is the score of all documents.
    """
    words, vectors = learn_vectors(docs, text)
    train = training_texts(docs.select("doc_id", F.col(text).alias("text")), labels, "quality", rows)
    shared = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def pooled():
        pooling = Pooling(*shared.value)
        return lambda column: [pooling(texts(column)).tolist()]

    known = append_columns(train, ["text"], "pooled array<double>", pooled, ["doc_id", "label"])
    known = known.toPandas().sort_values("doc_id")  # `rows` feature vectors at most
    y = (known["label"].to_numpy() > 0).astype(np.float64) if len(known) else np.zeros(0)
    shared.unpersist()
    if not 0 < y.sum() < len(y):
        return Quality(words, vectors, None, float(y.mean()) if len(y) else 0.5)
    return Quality(words, vectors, Network(np.stack(known["pooled"].to_numpy()), y), float(y.mean()))


def with_scores(docs: DataFrame, model: Quality, text: str = "text", score: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1.

    All documents are scored whole; null and empty texts get the score of a text without words. Repeated
    rows get equal scores. A column named like the new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = shared.value.scorer()
        return lambda column: [scorer(texts(column))]

    return append_columns(docs, [text], f"{score} double", start, keep)


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with quality_score: see ``fit`` for what is learnt from what, and ``with_scores``."""
    return with_scores(docs, fit(docs, labels, text, rows), text, keep=keep)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, labels, keep=["doc_id"]).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
