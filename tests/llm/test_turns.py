"""Repairs against a search over all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sitegauge.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults_of(rows):
    """Of rows in order (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(tr.WHITE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying all edits with up to two inserts anywhere."""
    faults, best = faults_of(rows), None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    per_row = []
    for (role, text), fault in zip(rows, faults):
        own = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            own += [(extra, "K", role)] if role else []
            own += [(2 + extra, "R", "user"), (2 + extra, "R", "assistant")]
        per_row.append(own)
    for chosen in itertools.product(*per_row):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""
            for k, (c, e, role) in enumerate([*chosen, (0, "", None)]):
                for name in gaps[k]:
                    cost, audit, initials = cost + 2, audit + "I", initials + name[0]
                    lines.append(f"{name}:")
                cost, audit = cost + c, audit + e
                if role is not None:
                    initials += role[0]
                    lines.append(f"{role}:{rows[k][1]}")
            if LEGAL.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def stepwise(rows):
    """The same by single edits from the end, for longer conversations."""
    faults, n = faults_of(rows), len(rows)
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {(n, s): (0, "", ()) if s in ("", "a") else (99, "", ()) for s in ("", "s", "u", "a")}

    def inserted(i):
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (s, x) in goes:
                        c, a, t = table[i, goes[s, x]]
                        table[i, s] = min(table[i, s], (c + 2, "I" + a, (f"{name}:", *t)))

    inserted(n)
    for i in range(n - 1, -1, -1):
        role, text = rows[i]
        for s in ("", "s", "u", "a"):
            c, a, t = table[i + 1, s]
            options = [(c + 3, "D" + a, t)]
            if faults[i] not in ("blank", "duplicate"):
                for x, name, e, price in ((role[:1], role, "K", 0), ("u", "user", "R", 2), ("a", "assistant", "R", 2)):
                    if (s, x) in goes:
                        c, a, t = table[i + 1, goes[s, x]]
                        options.append((c + price + (faults[i] == "truncated"), e + a, (f"{name}:{text}", *t)))
            table[i, s] = min(options)
        inserted(i)
    c, a, t = table[0, ""]
    return c, a, list(t)


def decided(rows):
    repair = tr.Repair()
    for (role, _), fault in zip(rows, faults_of(rows)):
        repair.add(role[:1], tr.FAULTS.index(fault))
    steps, end = repair.decided()
    cost, audit, lines = 0, "", []
    for (role, text), step, fault in zip(rows, steps, faults_of(rows)):
        if not step:
            cost, audit = cost + 3, audit + "D"
            continue
        before, state, reroled = (step - 1) // 8, (step - 1) // 2 % 4, (step - 1) % 2
        for x in tr.BETWEEN[before, state]:
            cost, audit = cost + 2, audit + "I"
            lines.append(f"{tr.ROLES[x]}:")
        cost, audit = cost + 2 * reroled + (fault == "truncated"), audit + "KR"[reroled]
        lines.append(f"{tr.ROLES[state] if reroled else role}:{text}")
    for x in end:
        cost, audit = cost + 2, audit + "I"
        lines.append(f"{tr.ROLES[x]}:")
    return cost, audit, lines


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "agent", "Useful"]
TEXTS = ["a.", "b!", "c", " ", "", "d?", "e. ", "a.", "long text", " ", "f.\n"]


def made_up(rng, n):
    return [(rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '', '!'])}") for _ in range(n)]


def test_all_edits_of_short_conversations():
    rng = random.Random(3)
    for _ in range(120):
        rows = made_up(rng, rng.randint(0, 3))
        assert decided(rows) == cheapest(rows) == stepwise(rows)


def test_longer_conversations_by_single_edits():
    rng = random.Random(4)
    for k in range(600):
        rows = made_up(rng, rng.randint(4, 40)) if k else made_up(rng, 500)
        assert decided(rows) == stepwise(rows)


def table(seed=5):
    rng, rows = random.Random(seed), []
    for c in range(60):
        rows += [(c, t, *r) for t, r in enumerate(made_up(rng, rng.randint(1, 12))) if rng.random() < 0.9]
    return rows


def summary(conv, rows):
    """What ``report`` gives for (turn, role, text) in order."""
    pairs = [(r, t) for _, r, t in rows]
    faults, turns = faults_of(pairs), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = stepwise(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in tr.LEGAL for a, b in zip(pairs, pairs[1:]))
    return conv, gaps, *(faults.count(f) for f in tr.FAULTS[1:]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def key(r):
    digest = hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), digest


def expected(rows):
    rows = sorted([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], key=key)
    return [summary(c, [r[1:] for r in own]) for c, own in itertools.groupby(rows, key=lambda r: r[0])]


ODD = [
    (None, 0, "user", "hello."), (None, None, "assistant", None), (100, None, None, None), (100, None, "user", "x."), (101, 1, "user", "same."), (101, 1, "user", "same."),
    (101, 3, "user", "same."), (101, 3, "assistant", "y"), (102, -5, "assistant", "."), (102, 900, "assistant", "z!"), (103, 0, "user", "long " * 50_000 + "end."),
]


def test_reports(spark):
    rows = table() + ODD
    got = tr.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_edits_carry_turns_and_texts(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "assistant", "hello."), (1, 2, "system", "no."), (1, 4, "user", "cut")]
    got = tr.repair_turns(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", Hash int, conv int")).orderBy("place").collect()
    cost, audit, lines = stepwise([r[2:] for r in rows])
    assert "".join(r.edit for r in got) == audit and [f"{r.role}:{r.text}" for r in got if r.edit != "D"] == lines
    assert [r.turn for r in got if r.edit != "I"] == [0, 1, 2, 4] and [r.fault for r in got if r.edit != "I"] == [None, "duplicate", None, "truncated"]
    assert [r.role_before for r in got if r.edit != "I"] == [r[2] for r in rows]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.report(empty).count() == tr.repair_turns(empty).count() == 0


def test_one_conversation_over_many_batches(spark):
    rng = random.Random(8)
    rows = [(7, t, *r) for t, r in enumerate(made_up(rng, 4000))] + [(8, 0, "user", "hi.")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = tr.report(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted(expected(rows))


@pytest.mark.parametrize("shared", [False, True])
def test_query_damages_and_reports(spark, tmp_path, shared):
    rows = [r for r in table(6) if r[2]] + [(200, t, "user", f"{t}.") for t in range(200 if shared else 1)] + [(None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    harmed = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        harmed += [(c, t, "user" if code == 4 else r, x)] * {0: 0, 3: 2}.get(code, 1)
    want = {r[0]: r for r in expected(harmed)}
    for c in {r[0] for r in rows} - want.keys():
        want[c] = (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sorted(map(tuple, tr.op12_turn_repair(spark, str(tmp_path)).collect()), key=str) == sorted(want.values(), key=str)
