"""Operator 1: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, scratch, texts, write_out
from sitegauge.llm.labelled import TRAIN_ROWS, held_out, training_texts
from sitegauge.sources.tables import read_table

#: Words that count as toxic whatever the labels say, with the weight of a sure sign.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "bitch", "asshole")
SEED_WEIGHT = 4.0
YOU = ("you", "your", "you're", "yours", "u", "ur", "tu", "toi", "te", "vous", "votre", "ton", "ta", "du", "dich", "dir", "dein", "deine", "ihr", "usted", "ti", "tú")
NEAR = 5  # words
#: Terms that the labels may add: whole words, and prefixes of these lengths.
PREFIXES = (3, 4, 5, 6)
LEXICON = 400
LEAST_DOCS, LEAST_Z, LEAST_ODDS = 3, 3.5, 1.2
#: Parts of the training documents. The features of each part come from a lexicon of the others; the last part calibrates.
FOLDS = 5
THRESHOLD = 0.3

#: Letters that digits and signs stand for.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGE = re.compile(r"^\W+|\W+$")
FEATURES = (
    "words", "density", "hit_rate", "hits", "strongest", "distinct", "near_you", "you_rate", "capitals", "capital_words",
    "exclamations", "punctuation", "mixed_words", "obfuscated", "stretched",
)
CACHE = 100_000
YOU_FLAG, CAPS_FLAG, MIXED_FLAG, HIDDEN_FLAG = 1, 2, 4, 8


def terms(word: str) -> list[str]:
    """The word and its prefixes, as lexicon terms."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def bare(token: str) -> str:
    return EDGE.sub("", token).lower()


class Features:
    """Dense features of whole texts. Tokens are looked at once each and their codes kept in a bounded cache."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.reset()
        self.letter_case = np.zeros(256, dtype=np.int8)
        self.letter_case[65:91], self.letter_case[97:123] = 1, 2
        for c in map(ord, "!?"):
            self.letter_case[c] = 3
        for c in map(ord, "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"):
            self.letter_case[c] = 4

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {(0.0, 0, ""): 0}
        self.weight, self.flags, self.term = [0.0], [0], [0]

    def weigh(self, word: str) -> tuple[float, str]:
        return max(((self.lexicon.get(t, 0.0), t) for t in terms(word)), default=(0.0, ""))

    def look(self, token: str) -> int:
        word = bare(token)
        weight, term = self.weigh(word)
        flags = YOU_FLAG * (word in YOU)
        flags |= CAPS_FLAG * (len(word) > 1 and EDGE.sub("", token).isupper())
        if not word.isalpha() and any(c.isalpha() for c in word):
            flags |= MIXED_FLAG
            plain = re.sub(r"[\W\d_]+", "", word.translate(LOOKS_LIKE))
            if not weight and plain != word:
                weight, term = self.weigh(plain)
                flags |= HIDDEN_FLAG * (weight > 0)
        kind = (weight, flags, term if weight else "")
        if kind not in self.kinds:
            self.kinds[kind] = len(self.weight)
            self.weight.append(weight)
            self.flags.append(flags)
            self.term.append(hash(kind[2]) if weight else 0)
        return self.kinds[kind]

    def one(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        for t in set(tokens).difference(self.codes):
            self.codes[t] = self.look(t)
        codes = np.fromiter(map(self.codes.__getitem__, tokens), dtype=np.int32, count=n)
        at = np.flatnonzero(codes)
        some = codes[at].tolist()
        weight = np.array([self.weight[c] for c in some])
        flags = np.array([self.flags[c] for c in some], dtype=np.int64)
        hit = weight > 0
        you = at[(flags & YOU_FLAG) > 0]
        hits = at[hit]
        near = 0
        if len(you) and len(hits):
            after = np.minimum(np.searchsorted(you, hits), len(you) - 1)
            gap = np.minimum(np.abs(you[after] - hits), np.abs(hits - you[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        upper, lower, shouts, marks = np.bincount(self.letter_case[raw], minlength=5)[1:5].tolist()
        same = (raw[1:] == raw[:-1]) & (self.letter_case[raw[1:]] > 0) if len(raw) > 2 else np.zeros(0, dtype=bool)
        share = 1000 / (n + 1)
        return [
            log(n + 1), float(weight.sum()) * share, len(hits) * share, log(len(hits) + 1), float(weight.max(initial=0)),
            float(len({self.term[c] for c, h in zip(some, hit) if h})), near * share, len(you) * share, upper / (upper + lower + 1),
            int(((flags & CAPS_FLAG) > 0).sum()) * share, shouts * share, marks * share, int(((flags & MIXED_FLAG) > 0).sum()) * share,
            float(((flags & HIDDEN_FLAG) > 0).sum()), int((same[1:] & same[:-1]).sum()) * share,
        ]

    def __call__(self, batch: list[str]) -> np.ndarray:
        if len(self.codes) > CACHE:
            self.reset()
        return np.array([self.one(t) for t in batch], dtype=np.float64).reshape(-1, len(FEATURES))


def unused_prefix(columns: list[str]) -> str:
    """A prefix that no column begins with."""
    prefix = "f_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text", keep: list[str] | None = None, prefix: str = "f_") -> DataFrame:
    """``df`` with the columns f_words, f_density and so on; null texts count as empty."""

    def start():
        features = Features(lexicon)

        def work(column):
            made = features(texts(column))
            return [pa.array(made[:, i], type=pa.float64()) for i in range(len(FEATURES))]

        return work

    return append_columns(df, [text], ", ".join(f"{prefix}{f} double" for f in FEATURES), start, keep)


def learn_lexicons(train: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Terms that stand in far more toxic than other training documents, with their log-odds.

    Item k is learnt from all documents but those of fold k, the last one from all. Tasks count the documents
    of each term by fold and label; the sums are made by Spark, and only ``size`` terms a lexicon come back.
    The seed words are always terms.
    """

    def count(batches):
        seen: dict[str, list[str]] = {}
        for batch in batches:
            found: dict[tuple[int, bool], Counter] = {}
            for t, label, fold in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = set(map(bare, set(t.split())))
                for w in words.difference(seen):
                    seen[w] = terms(w)
                found.setdefault((fold, label > 0), Counter()).update({x for w in words for x in seen[w]})
            for (fold, toxic), counts in found.items():
                columns = [pa.array(list(counts), pa.string()), pa.array([fold] * len(counts), pa.int32()), *[pa.array([n * (toxic == kind) for n in counts.values()], pa.int64()) for kind in (True, False)]]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "fold", "toxic", "clean"])

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", (F.col("label") > 0).alias("toxic")).count().collect()}
    counts = train.select("text", "label", "fold").mapInArrow(count, "term string, fold int, toxic long, clean long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c))).alias(f"{c}{k}") for k in range(FOLDS) for c in ("toxic", "clean")]
    summed = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *by_fold)
    summed = write_out(summed.where(F.col("toxic") >= LEAST_DOCS))
    out = []
    for k in range(FOLDS + 1):
        many, rest = [sum(n for (fold, toxic), n in sizes.items() if fold != k and toxic == kind) for kind in (True, False)]
        left = [F.col(c) - (F.coalesce(f"{c}{k}", F.lit(0)) if k < FOLDS else 0) for c in ("toxic", "clean")]
        a, b = left[0] + 0.5, left[1] + 0.5
        odds = F.log(a / (many + 1)) - F.log(b / (rest + 1))
        found = (
            summed.where(left[0] >= LEAST_DOCS)
            .select("term", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
            .where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
            .orderBy(F.desc("z"), "term")
            .limit(size)
        )
        out.append({"=" + w: SEED_WEIGHT for w in SEED_WORDS} | {r["term"]: r["odds"] for r in found.collect()})
    return out


def with_own_features(train: DataFrame, lexicons: list[dict[str, float]], prefix: str) -> DataFrame:
    """Features of training documents, each from the lexicon that its fold had no part in."""

    def start():
        by_fold = [Features(x) for x in lexicons]

        def work(column, folds):
            made = np.array([by_fold[fold].one(t) for t, fold in zip(texts(column), folds.to_pylist())], dtype=np.float64).reshape(-1, len(FEATURES))
            return [pa.array(made[:, i], type=pa.float64()) for i in range(len(FEATURES))]

        return work

    return append_columns(train, ["text", "fold"], ", ".join(f"{prefix}{f} double" for f in FEATURES), start, ["label", "fold"])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with toxic_score, the calibrated probability of label 1.

    A lexicon, trees and calibration are learnt from at most ``rows`` labelled documents (see
    ``training_texts``). These are dealt into FOLDS; a fold's features come from a lexicon of the others, so
    that neither trees nor calibration see a lexicon that knew their labels. Gradient-boosted trees grow
    on all folds but the last, by which isotonic regression calibrates them. The documents are then scored with
    the lexicon of all folds. The calibrated steps keep a thousandth of the trees' own probability, so that equal steps still rank.
    All documents are scored whole. Null and empty texts get the score of a text without words. Where the
    trees' or the calibrating part lacks labels of either kind, no trees are grown, and the score is 1 - exp(-hits
    of the lexicon). Repeated rows get equal scores. The columns of ``keep`` (all by default) keep their values.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "toxic_score"]
    own = unused_prefix(keep)  # features have names that no column of the caller has
    with scratch(docs.sparkSession):
        lexicon, trees, steps = fit(docs, labels, text, rows, own)
    featured = with_features(docs, lexicon, text, keep, own)
    if trees is None:
        return featured.select(*keep, (1 - F.exp(1 - F.exp(f"{own}hits"))).alias("toxic_score"))
    scored = steps.transform(trees.transform(feature_vectors(own).transform(featured)).withColumn(f"{own}raw", vector_to_array(f"{own}p")[1]))
    return scored.select(*keep, (0.999 * F.col(f"{own}steps") + 0.001 * F.col(f"{own}raw")).alias("toxic_score"))


def feature_vectors(own: str) -> VectorAssembler:
    return VectorAssembler(inputCols=[own + f for f in FEATURES], outputCol=f"{own}vector")


def fit(docs: DataFrame, labels: DataFrame, text: str, rows: int, own: str) -> tuple[dict[str, float], GBTClassificationModel | None, IsotonicRegressionModel | None]:
    """Lexicon, trees and calibration; no trees where the labels of a part are of one kind only."""
    train = training_texts(docs.select("doc_id", F.col(text).alias("text")), labels, "toxic", rows)
    train = write_out(train.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int")))
    *lexicons, lexicon = learn_lexicons(train)
    steps_part = F.col("fold") == FOLDS - 1
    kinds = {(r["part"], r["toxic"]) for r in train.select(steps_part.alias("part"), (F.col("label") > 0).alias("toxic")).distinct().collect()}
    if len(kinds) < 4:
        return lexicon, None, None
    known = feature_vectors(own).transform(write_out(with_own_features(train, lexicons, own)))
    known = known.select("fold", F.col("label").cast("double").alias("label"), f"{own}vector").coalesce(1)
    grower = GBTClassifier(
        featuresCol=f"{own}vector", labelCol="label", predictionCol=f"{own}c",
        maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=4, seed=17,
    )
    trees = grower.setProbabilityCol(f"{own}p").setRawPredictionCol(f"{own}r").fit(known.where(~steps_part))
    calibrate = trees.transform(known.where(steps_part)).select("label", vector_to_array(f"{own}p")[1].alias(f"{own}raw"))
    return lexicon, trees, IsotonicRegression(featuresCol=f"{own}raw", labelCol="label", predictionCol=f"{own}steps").fit(calibrate)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
