"""Near duplicates, near vectors and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from sitegauge.llm import embedding_dedup, minhash_dedup
from sitegauge.llm.components import connected_components, forest


def roots_of(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(400, 400), (500, 501), (501, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of(502, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array(links).T
    assert forest(502, a, b).tolist() == want


def shingles(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    dense = [word() for _ in range(80)]
    for _ in range(200):  # more than a node's share, so that nodes branch
        c = list(dense)
        for _ in range(rng.randint(1, 3)):
            c[rng.randrange(80)] = word()
        texts.append(" ".join(c))
    texts += [None, "", " \n\t ", "one", "ONE", "two words", "Two  words", base[0][0]] + [texts[0]] * 30 + [texts[0].upper()]
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    for words, small in ((4, False), (4, True), (5, False)):
        if small:  # bundles go through pivots and blocks
            for name, size in (("BUNDLE_BYTES", 2000), ("BLOCK_BYTES", 20_000), ("PIVOT_BYTES", 20_000)):
                monkeypatch.setattr(minhash_dedup, name, size)
        sets = [shingles(t, words) for t in texts]
        links = [
            (i, j) for i in range(len(sets)) for j in range(i)
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
        ]
        want = roots_of(len(texts), links)
        got = sorted(minhash_dedup.near_duplicates(docs, words=words).collect())
        assert [r.n_shingles for r in got] == [len(s) for s in sets]
        assert [r.component_id for r in got] == [3 * w for w in want]
        assert [r.kept for r in got] == [i == w for i, w in enumerate(want)]


def test_paths_of_pairs_in_crowds_that_are_not_dense():
    """Pairs of similarity 0.8 share a path however often their nodes branch; a miss has a chance of 1e-4 a pair at the last level."""
    rng = np.random.default_rng(5)
    n = minhash_dedup.VALUES
    one = rng.integers(0, 2**32, (2000, n), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 2**32, one.shape, dtype=np.uint32))
    sketches = [x.tobytes() for pair in zip(one, two) for x in pair]  # classes 2i and 2i + 1 are a pair
    batch = pa.RecordBatch.from_pydict({"class": np.arange(len(sketches)), "sketch": sketches})
    for level in range(1, minhash_dedup.LEVELS + 1):
        (made,) = minhash_dedup.branch([batch], roots=level == 1)
        rows = sorted(zip(made.column("path").to_pylist(), made.column("class").to_pylist()))
        shared = [(p, c) for (p, a), (q, b) in zip(rows, rows[1:]) if p == q and a // 2 == b // 2 for c in (a, b)]
        assert len({c // 2 for _, c in shared}) >= len(one) - (2 if level > 2 else 0), level
        path, own = zip(*shared)
        batch = pa.RecordBatch.from_pydict({"path": path, "class": own, "n": [1000] * len(own), "sketch": [sketches[c] for c in own]})


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", (4 * 16 * 70, 4 * 16 * 70))
    monkeypatch.setattr(embedding_dedup, "STRETCH_BYTES", (4 * 16 * 140, 4 * 16 * 140))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [c + rng.normal(size=16) * s for c in centres for s in rng.uniform(0.02, 0.5, 12)]
    rows += [rows[0]] * 40 + [rows[0] * 2.5, -rows[0]]
    vectors = [[float(np.float32(x)) for x in r] for r in rows]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, vectors[0][:8], [*vectors[0][:15], None]]
    df = spark.createDataFrame([(i * 2, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n_links int")
    good = [i for i, v in enumerate(vectors) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([vectors[i] for i in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = [(good[i], good[j]) for i, j in zip(*np.nonzero(near)) if i != j]
    want = roots_of(len(vectors), links)
    counts = np.zeros(len(vectors), dtype=int)
    counts[good] = near.sum(1) - 1
    got = sorted(embedding_dedup.near_vectors(df).collect())
    assert [r.n_links for r in got] == counts.tolist()
    assert [r.component_id for r in got] == [2 * w for w in want]
    assert [r.kept for r in got] == [i == w for i, w in enumerate(want)]


def test_near_vectors_of_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, False), (1, 1, True), (1, 1, True)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(df.where("vec_id is null")).first().n_links == 0


def test_near_vectors_of_other_types_and_widths(spark):
    rows = [(i, [x]) for i, x in enumerate((3, -2, 5, 0, 7, -1))]
    for kind in ("int", "decimal(10,2)", "double", "float"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<int>").selectExpr("vec_id", f"CAST(embedding AS array<{kind}>) AS embedding")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
        assert got == {0: (2, 0), 2: (2, 0), 4: (2, 0), 1: (1, 1), 5: (1, 1), 3: (0, 3)}, kind


def test_recall_over_a_few_thousand_documents(spark):
    """Links found by chosen paths, of all links of similarity 0.8 or more by brute force, in crowds that share passages."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(1200):  # crowds: three fifths of a text is a passage of hundreds of texts, and so no link
        own = [word() for _ in range(40)]
        texts.append([*passages[i % 4], *own])
        if i % 3 == 0:  # a partner, changed until the similarity is between 0.8 and about 0.85
            partner = [*passages[i % 4], *own]
            for p in (70, 88):
                partner[p] = word()
            texts.append(partner)
    sets = [shingles(" ".join(t), 5) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        for e in s:
            first.setdefault(e, []).append(i)
    number = {e: k for k, e in enumerate(first)}
    has = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [number[e] for e in s]] = 1
    common, size = (has @ has.T).astype(int), np.array([len(s) for s in sets])
    links = [(a, b) for a, b in np.argwhere(100 * common >= 80 * (size[:, None] + size - common)).tolist() if a < b]
    assert len(links) == 400
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert sum(got[a] == got[b] for a, b in links) / len(links) == 1.0
    assert sum(got[i] == i for i in got) == len(texts) - len(links)


def test_large_bundles_are_told_apart_by_longer_sketches(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUNDLE_BYTES", 5000)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(150)]
    texts = [[*shared, *[word() for _ in range(60)]] for _ in range(60)]  # similarity about 0.55 by pairs
    texts += [[*t[:-1], word()] for t in texts[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [(i, np.sort(np.array([hash(e) & (2**63 - 1) for e in shingles(" ".join(t), 5)], dtype=np.uint64)).tobytes()) for i, t in enumerate(texts)]
    members = spark.createDataFrame([(i, 0, 9999, len(b) // 8, bytearray(b)) for i, b in rows], "class long, bundle long, bytes long, size long, shingles binary")
    left = minhash_dedup.refined(members, 80)
    assert left.groupBy("bundle").count().where("count = 2").count() == left.select("bundle").distinct().count() == 10
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: i if i < 60 else i - 60 for i in range(70)}
