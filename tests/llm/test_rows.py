"""Sharding, URL verdicts, secrets and benchmark passages on small fixtures, against plain versions."""

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sitegauge.llm import decontaminate, registry, secret_scan, sharding, url_filter
from sitegauge.llm.fm_index import FMIndex


def sql(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.sql(registry.ORACLES[name]).df()


def same(df, expected):
    got = df.toPandas()
    cols = sorted(expected.columns)
    assert sorted(got.columns) == cols
    key = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(expected)


def test_shards_are_even_and_complete(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1000)] + [(7, "copy")] * 500 + [(None, None), (1, ""), (2, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", sharding.F.lit(3))
    got = sharding.shuffle_into_shards(docs, bucket_bytes=2000).toPandas()
    assert len(got) == len(rows) and set(got.columns) == {"doc_id", "text", "law", "shard", "slot"}
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(sizes) == 24 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    want, have = Counter(rows), Counter((None if pd.isna(a) else int(a), b) for a, b in zip(got.doc_id, got.text))
    assert want == have
    order = got.dropna().sort_values(["slot", "shard"]).doc_id.tolist()
    assert order != sorted(order)


def test_shards_of_an_empty_table_and_written_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    few = sharding.shuffle_into_shards(docs.limit(3)).toPandas()
    assert len(few) == 3 and few.shard.nunique() == 3 and (few.slot == 0).all()
    made = sharding.shuffle_into_shards(docs, shards=3, bucket_bytes=100)
    sharding.write_shards(made, str(tmp_path / "out"))
    for shard in range(3):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [x for f in files for x in pq.read_table(f, partitioning=None).column("slot").to_pylist()]
        assert slots == list(range(len(slots))) and len(slots) in (33, 34)


def test_the_draw_is_repeatable_and_even(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "'x' AS text").coalesce(2)
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 2, seed, 150).collect()}
    runs = [place(seed) for seed in range(12)]
    assert runs[3] == place(3) and len({tuple(sorted(r.items())) for r in runs}) == 12
    # Of 720 places of records, those in the first shard, and those that follow their neighbour's place.
    first = sum(shard == 0 for r in runs for shard, _ in r.values())
    assert first == 360
    low = sum(r[i][0] == 0 for r in runs for i in range(30))
    follow = sum((r[i][0], r[i][1] + 1) == r[i + 1] for r in runs for i in range(59))
    assert 140 < low < 220 and follow < 40  # means 180 and 12


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://example.org/es", "http://a.example.org/en/1", "http://a.example.org/en/123?q",
    "http://a.example.org/en/2", "http://org/", "http://org", "http://xorg/", "http://a.com/fr/", "http://a.com/FR/", "http://a.com/de/9#f",
    "http://b.com:80/de/9", "http://u@b.com/de/9", "http://spam-farm.example.net/x", "http://notspam-farmers.net/", "http://x.net/a.zip",
    "http://x.net/a.zip?d=1", "x://y://z.org/a", "http://É.org/ä\n/b", "http://casino.x.net", "http://CASINO.x.net/EXE.EXE", "a://casino.com/fr/",
]


def test_url_verdicts_equal_sql(spark):
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict")
    same(got, sql("op2_url_verdicts", pages=pages))
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_each_rule_is_in_the_index_once(spark):
    rules = url_filter.default_rules()
    column, slots = url_filter.index_rules(rules, {"example": 900, "org": 1000, "spam": 5, "farm": 7})
    table = spark.range(1).select(column.alias("t")).first().t
    assert len(table) == slots
    entries = [(i, e) for i, slot in enumerate(table) for e in slot]
    assert sorted(e.pattern for _, e in entries) == sorted(r.pattern for r in rules)
    assert all(i == zlib.crc32(e.token.encode()) % slots for i, e in entries)
    token = {e.pattern: e.token for _, e in entries}
    assert [token[r.pattern] for r in rules if r.tokens == ("spam", "farm")] == ["spam"]
    assert [token[r.pattern] for r in rules if r.name == "example.org/es/"] == ["es"]


def test_rules_in_several_passes(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, *URLS, "http://x.net/" + "long-path/" * 20_000 + "a.zip"])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    more = [url_filter.prefix_rule(f"host{i}.net/p{i}/", "block") for i in range(40)] + [url_filter.prefix_rule("example.org/es/", "allow")]
    rules = [*url_filter.default_rules(), *more]
    at_once = sorted(url_filter.judge_urls(df, rules).collect(), key=lambda r: r.page_id)
    for most in (1, 20):
        assert sorted(url_filter.judge_urls(df, rules, most=most).collect(), key=lambda r: r.page_id) == at_once
    assert at_once[-1].verdict == "block"
    with pytest.raises(ValueError):
        url_filter.judge_urls(df, [url_filter.Rule("x", ".*", (), "block", 1)])


def plain_secrets(text):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_equal_plain_version():
    rng = random.Random(5)
    bits = ["password", "Token", "api_key", "=", ": ", '"', "'", " ", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12", "é", "_", ".", "secret", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == plain_secrets(text), text


def test_entropy_windows_equal_plain_version():
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("ab1Z9xQ/+") if rng.random() < 0.6 else "a" for _ in range(rng.randint(20, 60)))
        hot = set()
        for i in range(len(word) - 19):
            part = word[i : i + 20]
            h = -sum(n / 20 * np.log2(n / 20) for n in Counter(part).values())
            if h >= 2.5 - 1e-9 and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                hot.update(range(i, i + 20))
        assert {k for a, b in secret_scan.hot_windows(word, 20, 2.5) for k in range(a, b)} == hot


def test_secrets_equal_sql(spark):
    rng = random.Random(9)
    bits = ["password=", "Token: ", "api_key=\"", "abc", "q8Zr1Tx0Lw5Vb7Nc3Md9Ks2Hy4", "0123456789abcdef", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "AKIA", "ABCDEFGH12345678", "é", "_", "x" * 30,
            " ", "\n", "example", "sha256-", "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "aaaaaaaaaaaaaaaaaaaab1b1b1", "zz9/+qQ7=Kd2Lw8"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "é" * 50 + " token=abcdef", texts_of_words(rng)]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = [f"cast(size(filter(secret_spans, s -> s.kind = '{k}')) AS long) AS n_{k}" for k in secret_scan.KINDS[:3]]
    found = secret_scan.find_secrets(df, keep=["doc_id"])
    got = found.select("doc_id", *map(secret_scan.F.expr, counts), secret_scan.F.sha2(secret_scan.joined(secret_scan.KINDS[:3]), 256).alias("base_sha256"), secret_scan.joined().alias("spans"))
    same(got, sql("op3_secret_spans", documents=docs))


def texts_of_words(rng):
    return " ".join(f"token={rng.getrandbits(160):040x} q8Zr1Tx0Lw5Vb7Nc3Md9Ks2Hy4{i}" for i in range(200))


def test_many_base_spans_take_linear_time():
    text = " ".join(f"token=x{i:08d}y secret=q8Zr1Tx0Lw5Vb7Nc3Md9Ks2Hy4 q8Zr1Tx0Lw5Vb7Nc3Md9Ks2Hy4" for i in range(20_000))
    began = time.process_time()
    spans = secret_scan.Scanner().spans(text)
    assert Counter(k for _, k, _ in spans) == {0: 40_000, 3: 20_000}
    assert time.process_time() - began < 10  # seconds; a check against every base span would take hundreds


def test_secrets_of_odd_rows(spark):
    key = "q8Zr1Tx0Lw5Vb7Nc3Md9Ks2Hy4"
    rows = [(1, None), (2, ""), (3, f"see {key} now"), (4, f"example_{key}"), (5, "x" * 200_000 + f" {key}"), (3, f"see {key} now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secret_spans", secret_scan.F.lit(1))
    got = [[tuple(s) for s in r.secret_spans] for r in secret_scan.find_secrets(docs).collect()]
    assert got[:2] == [[], []] and got[2] == [("entropy", 4, 30)] == got[5] and got[3] == [] and len(got[4]) == 1
    assert secret_scan.redact_secrets(docs).collect()[2].text == "see [entropy] now"
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for trial in range(60):
        size = int(rng.integers(1, 5))
        s = np.append(rng.integers(0, size + 1, rng.integers(1, 50)), 0)
        s = np.concatenate([s, s]) if trial % 3 == 0 else s
        index = FMIndex(s, size)
        for n in (1, 2, 4):
            patterns = rng.integers(1, size + 1, (15, n))
            for p, a, b in zip(patterns, *index.search(patterns)):
                want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
                assert (sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []) == want


def passages():
    rng = random.Random(8)
    words = ["Alpha", "beta", "gämma", "d4", "e", "über"]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 9, 10, 11, 25, 25, 40)] + ["", None, "?!"]
    texts = [" - ".join(rng.choice([*words, rng.choice(items[3:8]) or ""]) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts += [None, "", "...", items[7], items[7].upper(), items[7] * 200] + [items[6]] * 5
    return list(enumerate(texts)), list(enumerate(items))


def test_passages_equal_sql(spark):
    texts, items = passages()
    for some in (items, items[3:], [*items[:4], (None, items[5][1]), (None, "gämma"), *items[6:]]):
        docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_words int")
        bench = spark.createDataFrame(some, "item_id long, text string")
        expected = sql("op4_benchmark_passages", documents=pd.DataFrame(texts, columns=["doc_id", "text"]), benchmark=pd.DataFrame(some, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
        for block_bytes in (1 << 20, 100):
            found = decontaminate.find_passages(docs, bench, keep=["doc_id"], block_bytes=block_bytes)
            hits = "aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)"
            got = found.selectExpr("doc_id", "n_words", f"{hits} AS n_hit", "cast(size(hit_items) AS long) AS n_items", "sha2(array_join(hit_items, ','), 256) AS items_sha256", "size(hit_spans) > 0 AS contaminated")
            same(got, expected)


def test_passages_of_long_items_and_small_shards(spark, monkeypatch):
    texts, items = passages()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 500)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.find_passages(docs, bench, keep=["doc_id"]).collect()
    rows = [(f"={i}", t) for i, t in items if t]
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    batch = pa.RecordBatch.from_pydict({"i": [i for i, _ in rows], "t": [t for _, t in rows]})
    (cut,) = decontaminate.pieces([batch], 10)
    assert cut.num_rows > len(rows)
    one, two = decontaminate.Phrases.of(rows, 10), decontaminate.Phrases.of(list(zip(*cut.to_pydict().values())), 10)
    named = lambda p: {(tuple(w.tolist()), tuple(p.items_of(n, k))) for n, ws in p.windows.items() for k, w in enumerate(ws)}
    back = lambda p: {(tuple({v: k for k, v in p.symbols.items()}[x] for x in w), i) for w, i in named(p)}
    assert back(one) == back(two)
    search = decontaminate.ShardSearch(two)
    for (counts, spans, found), row in zip(((search([t or ""])) for _, t in texts), want):
        assert counts[0] == row.n_words and decontaminate.ids_of(found[0]) == row.hit_items and spans[0] == [tuple(s) for s in row.hit_spans]


def test_passages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 2.5)], "doc_id long, text string, n_words string, hit_spans double")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.remove_passages(docs, bench).collect()] == [(1, "a ", "mine", 2.5)]


def test_passages_are_cut(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "Keep this, " + " ".join(words[5:20]) + "; and this."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [r.text for r in decontaminate.remove_passages(docs, bench).collect()] == ["Keep this, ; and this.", "clean", None]
    assert decontaminate.find_passages(docs, bench.limit(0)).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0
