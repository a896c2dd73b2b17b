"""Operator 13: languages by a blended-spectrum string kernel, Nyström landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, scratch, write_out
from sitegauge.llm.labelled import held_out
from sitegauge.sources.tables import read_table

#: Lengths of n-grams whose presence the kernel compares; three code points of 21 bits fill a long.
LENGTHS, BITS = (1, 2, 3), 21
#: Documents that are learnt from at most, those of them that are landmarks, both dealt evenly over the languages; and languages that are learnt.
TRAIN_ROWS, LANDMARKS, LANGUAGES = 4000, 192, 96
#: Landmarks are whole documents of at most so many characters where the language has enough of them, else its shortest ones.
LANDMARK_CHARS = 20_000
#: Ridge, relative to the number of rows, and the least share of the largest eigenvalue that is inverted.
RIDGE, LEAST_SHARE = 1e-3, 1e-6
#: Characters of a text that are looked at together.
PIECE = 1 << 20
UNKNOWN = "und"
WHITE = 32


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def spelt(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of other characters than letters as one space, with one at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    codes = np.where(letters()[codes], codes, WHITE)
    again = (codes[1:] == WHITE) & (codes[:-1] == WHITE)
    return codes[np.concatenate([[True], ~again])]


def distinct(grams: np.ndarray) -> np.ndarray:
    """The different ones of sorted numbers."""
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams


def gram_set(text: str) -> np.ndarray:
    """The different n-grams of a text as numbers: its code points, the first highest, below a 1 bit where there are fewer than three.

    Shorter n-grams are the beginnings of longer ones, but for the last, so that only the longest are sorted.
    """
    codes = spelt(text)
    if len(codes) < 3:  # no letter
        return np.zeros(0, dtype=np.int64)
    sets: list[np.ndarray] = []
    for a in range(0, len(codes) - 2, PIECE):
        some = codes[a : a + PIECE + 2]
        sets.append(distinct(np.sort((some[:-2] << 2 * BITS) | (some[1:-1] << BITS) | some[2:])))
    three = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
    two = np.unique(np.append(distinct(three >> BITS), (codes[-2] << BITS) | codes[-1]))
    return np.concatenate([distinct(two >> BITS) | MARKS[0], two | MARKS[1], three | MARKS[2]])  # the last code point is a space, as the first is


#: What tells the numbers of shorter n-grams from those of longer ones: a code point that no text has, in front.
MARKS = (0x1FFFFF << 2 * BITS | 0x1FFFFF << BITS, 0x1FFFFF << 2 * BITS, 0)


class Landmarks:
    """n-grams of the landmarks: which landmarks have each, and how many each landmark has."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.float64)
        every = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.grams, self.starts = np.unique(every[order], return_index=True)
        self.owners = owner[order].astype(np.int32)
        self.ends = np.append(self.starts[1:], len(every))

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Places in ``self.grams`` of those that it has."""
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        return at[self.grams[at] == grams] if len(self.grams) else at[:0]

    def kernel(self, grams: np.ndarray) -> np.ndarray:
        """Shared n-grams with each landmark over the geometric mean of the numbers of n-grams."""
        at = self.known(grams)
        counts = self.ends[at] - self.starts[at]
        places = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else at
        shared = np.bincount(self.owners[places], minlength=len(self.sizes))
        return shared / np.sqrt(np.maximum(1, len(grams)) * np.maximum(1, self.sizes))


class Languages:
    """One regression for each language, as weights of n-grams: what the landmarks' weights come to.

    A text's margin for a language is a weighted sum of its kernels with the landmarks, and a kernel is a sum over shared n-grams, so
    that both sums are one product of the text's presence vector with a matrix of n-grams and languages.
    """

    def __init__(self, names: list[str], landmarks: Landmarks | None = None, kernels: np.ndarray | None = None, labels: np.ndarray | None = None):
        self.names, self.grams, self.weights, self.offset, self.slope = names, np.zeros(0, dtype=np.int64), None, None, 1.0
        if landmarks is None or len(names) < 2:
            return
        whole = [landmarks.grams[:0]] * len(landmarks.sizes)
        for k in range(len(whole)):
            whole[k] = landmarks.grams[np.unique(np.searchsorted(landmarks.starts, np.flatnonzero(landmarks.owners == k), side="right") - 1)]
        among = np.array([landmarks.kernel(s) for s in whole])
        value, vector = np.linalg.eigh((among + among.T) / 2)
        used = value > LEAST_SHARE * value[-1]
        root = vector[:, used] / np.sqrt(value[used])
        features = kernels @ root
        mean = features.mean(0)
        truth = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
        share = 1 / np.bincount(labels, minlength=len(names))[labels]  # every language weighs the same
        share *= len(labels) / share.sum()
        x = (features - mean) * np.sqrt(share)[:, None]
        level = (truth * share[:, None]).mean(0)
        fit = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]), x.T @ ((truth - level) * np.sqrt(share)[:, None]))
        self.offset = level - mean @ fit
        margins = features @ fit + self.offset
        self.slope = min(np.geomspace(0.5, 16, 40).tolist(), key=lambda t: self.loss(margins * t, labels))
        per_landmark = root @ fit / np.sqrt(np.maximum(1, landmarks.sizes))[:, None]
        self.grams = landmarks.grams
        self.weights = np.add.reduceat(per_landmark[landmarks.owners], landmarks.starts, axis=0).astype(np.float32)

    @staticmethod
    def loss(margins: np.ndarray, labels: np.ndarray) -> float:
        return float(np.mean(np.logaddexp.reduce(margins, axis=1) - margins[np.arange(len(labels)), labels]))

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each text: the product of the batch's sparse presence matrix with the weights, over the texts' norms."""
        grams, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        there = (self.grams[at] == grams)[:, None]
        sums = np.add.reduceat(np.where(there, self.weights[at], 0).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return sums / np.sqrt(sizes)[:, None] + self.offset

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share among all languages; ties go to the first by name."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        sets = [gram_set(t or "") for t in texts]
        some = [i for i, s in enumerate(sets) if len(s)]
        if not some or not self.names:
            return names, scores
        if self.weights is None:
            for i in some:
                names[i], scores[i] = self.names[0], 1.0
            return names, scores
        for a in range(0, len(some), 64):
            part = some[a : a + 64]
            margins = self.margins([sets[i] for i in part])
            shares = np.exp(margins * self.slope - np.logaddexp.reduce(margins * self.slope, axis=1, keepdims=True))
            for i, best, share in zip(part, margins.argmax(1).tolist(), shares.max(1).tolist()):
                names[i], scores[i] = self.names[best], min(1.0, share)
        return names, scores


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, rows: int, landmarks: int, languages: int) -> tuple[list[str], DataFrame]:
    """Names of the languages in order, and (doc_id, lang, text, place, landmark) of some documents of each.

    Of each language an equal share of ``rows`` documents, those of the smallest hashes of their ids, and of them an equal share of ``landmarks``.
    Repeated rows of an id in a language count once, with their first text in order.
    """
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id) & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    known = known.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    length = F.char_length("text")
    ids = write_out(known.groupBy("lang", "doc_id").agg(F.min(F.when(length > LANDMARK_CHARS, length).otherwise(0)).alias("long")))
    counts = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    names = sorted(r["lang"] for r in counts.collect())
    each, marks = max(1, rows // max(1, len(names))), max(1, landmarks // max(1, len(names)))
    first, short = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"), Window.partitionBy("lang").orderBy("long", "n")
    some = ids.where(F.col("lang").isin(names)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    some = some.withColumn("place", F.row_number().over(short)).select("lang", "doc_id", "place")
    found = known.join(F.broadcast(some), ["lang", "doc_id"])  # at most `rows` ids, or one for each language
    found = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.first("place").alias("place"))
    return names, found.withColumn("landmark", F.col("place") <= marks)


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, languages: int = LANGUAGES,
) -> Languages:
    """Learns from at most ``rows`` documents that are not held out, of at most ``languages`` languages, the most frequent ones.

    The landmarks' n-grams and the training rows' kernels with them come to the driver: at most rows x landmarks numbers, and the n-grams of
    ``landmarks`` texts, of at most LANDMARK_CHARS characters each where a language has so many of that length.
    """
    with scratch(docs.sparkSession):
        names, train = training_rows(docs, doc_id, text, lang, rows, landmarks, languages)
        if not names:
            return Languages([])
        train = write_out(train)

        def grams():
            return lambda column: [[gram_set(t).tolist() for t in column.to_pylist()]]

        few = append_columns(train.where("landmark"), ["text"], "grams array<long>", grams, ["doc_id", "lang", "place"])
        marks = Landmarks([np.array(r["grams"], dtype=np.int64) for r in sorted(few.collect(), key=lambda r: (r["lang"], r["place"]))])
        shared = docs.sparkSession.sparkContext.broadcast(marks)

        def kernels():
            return lambda column: [[shared.value.kernel(gram_set(t)).tolist() for t in column.to_pylist()]]

        known = append_columns(train, ["text"], "kernel array<double>", kernels, ["lang", "place"]).collect()
        shared.unpersist()
        known.sort(key=lambda r: (r["lang"], r["place"]))
        labels = np.array([names.index(r["lang"]) for r in known])
        return Languages(names, marks, np.array([r["kernel"] for r in known]), labels)


def with_languages(docs: DataFrame, model: Languages, text: str = "text", pred: str = "lang_pred", score: str = "lang_score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pred`` and ``score`` (0 to 1, the language's share among all learnt ones).

    Whole texts are looked at, by the presence of their n-grams. Null texts, texts without a letter, and all texts where nothing
    was learnt are ``und`` with a score of 0; with one learnt language every other text has it, with 1. Repeated rows get equal results. Columns named
    like the new ones are replaced. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda column: [*shared.value(column.to_pylist())]

    return append_columns(docs, [text], f"{pred} string, {score} double", start, keep)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_languages(docs, fit(docs), score="score", keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
