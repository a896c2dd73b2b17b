"""Languages against kernels by plain sets, and by held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from sitegauge.llm import language_id as li

PARTS = {
    "xa": ["tha", "ing", "ent", "ion", "wh", "oo", "ck"], "xb": ["sch", "ein", "ung", "ü", "ß", "ge", "ck"],
    "xc": ["eau", "oux", "tion", "é", "ça", "qu", "le"], "xd": ["ción", "ñ", "ll", "os", "ar", "que", "el"],
}
SCHEMA = "doc_id long, text string, lang string"


def made_up(rng, lang, words):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def plain_grams(text):
    spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if not spaced.strip():
        return set()
    return {spaced[i : i + n] for n in li.LENGTHS for i in range(len(spaced) - n + 1)}


def number(gram):
    value = 0
    for c in gram:
        value = value << li.BITS | ord(c)
    return value | li.MARKS[len(gram) - 1]


ODD = ["", " \n12 !", "a", "A", "é", "a b", "  Ab1cd--ef ", "İx \U00020000y", "aaaa aaaa", "x" * 3000 + " y", "漢字かな交じり文", "١٢٣ ن"]


def test_sets_of_grams():
    rng = random.Random(1)
    for text in [*ODD, *(made_up(rng, k, 40) for k in PARTS)]:
        grams = li.gram_set(text)
        assert len(set(grams.tolist())) == len(grams) and set(grams.tolist()) == {number(g) for g in plain_grams(text)}


def test_long_texts_are_looked_at_in_pieces(monkeypatch):
    text = made_up(random.Random(2), "xb", 500)
    whole = set(li.gram_set(text).tolist())
    monkeypatch.setattr(li, "PIECE", 100)
    assert set(li.gram_set(text).tolist()) == whole


def test_margins_are_those_of_kernels_with_all_landmarks():
    rng = random.Random(3)
    names = sorted(PARTS)
    train = [(made_up(rng, n, rng.randint(3, 60)), k) for k, n in enumerate(names) for _ in range(30)]
    marks = [t for t, _ in train][::7]

    def kernel(a, b):
        a, b = plain_grams(a), plain_grams(b)
        return len(a & b) / np.sqrt(len(a) * len(b))

    landmarks = li.Landmarks([li.gram_set(t) for t in marks])
    kernels = np.array([landmarks.kernel(li.gram_set(t)) for t, _ in train])
    assert np.allclose(kernels, [[kernel(t, m) for m in marks] for t, _ in train])
    labels = np.array([k for _, k in train])
    model = li.Languages(names, landmarks, kernels, labels)

    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(among)
    root = vector[:, value > li.LEAST_SHARE * value[-1]] / np.sqrt(value[value > li.LEAST_SHARE * value[-1]])
    x, y = kernels @ root, np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, level = x.mean(0), y.mean(0)  # the languages are of one size
    ridge = np.linalg.solve((x - mean).T @ (x - mean) + li.RIDGE * len(x) * np.eye(x.shape[1]), (x - mean).T @ (y - level))
    new = [made_up(rng, n, 15) for n in names] + ["zzz", "a"]
    want = [(np.array([kernel(t, m) for m in marks]) @ root - mean) @ ridge + level for t in new]
    assert np.allclose(model.margins([li.gram_set(t) for t in new]), want, atol=1e-4)
    assert model(new)[0][: len(names)] == names


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        lang = rng.choice(["xa", "xa", "xa", *PARTS])
        rows.append((i, made_up(rng, lang, rng.randint(3, 80)), lang))
    return rows


def test_held_out_accuracy_and_repeated_rows(spark, docs):
    rows = docs + docs[:40] + [(5000, None, "xa"), (5001, "12 %", "xb"), (5002, "", None), (5003, made_up(random.Random(5), "xd", 40_000), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = li.with_languages(df, li.fit(df, rows=400, landmarks=60)).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 150 and np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    by_id = {}
    for r in got:
        assert 0 <= r.lang_score <= 1 and by_id.setdefault(r.doc_id, (r.lang_pred, r.lang_score)) == (r.lang_pred, r.lang_score)
    assert [by_id[i] for i in (5000, 5001, 5002)] == [(li.UNKNOWN, 0.0)] * 3 and by_id[5003][0] == "xd"


def test_held_out_rows_teach_nothing(spark, docs):
    inside = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    wrong = [(i, t, "zz") for i, t, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    a, b = (li.fit(spark.createDataFrame(rows, SCHEMA), rows=100, landmarks=20) for rows in (inside, inside + wrong))
    assert a.names == b.names and (a.weights == b.weights).all()


def test_little_to_learn_from(spark):
    none = spark.createDataFrame([(0, "abc", None), (1, "  ", "xa"), (None, "abc", "xb")], SCHEMA)
    assert {(r.lang_pred, r.lang_score) for r in li.with_languages(none, li.fit(none)).collect()} == {(li.UNKNOWN, 0.0)}
    one = spark.createDataFrame([(0, "abc", "xa"), (1, "!", "xb"), (3, "def", None)], SCHEMA)
    assert sorted((r.doc_id, r.lang_pred, r.lang_score) for r in li.with_languages(one, li.fit(one)).collect()) == [(0, "xa", 1.0), (1, "und", 0.0), (3, "xa", 1.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert li.with_languages(empty, li.fit(empty)).count() == 0


def test_only_frequent_languages_are_learnt(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    assert li.fit(df, rows=100, landmarks=20, languages=1).names == ["xa"]
