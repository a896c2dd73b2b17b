"""Operator 12: the cheapest repair of conversations that lost turns or hold empty, repeated, cut or wrongly ascribed ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.sources.tables import read_table

#: What the edits of a turn cost: another role, deletion, a new turn without text; and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
#: States of a repaired beginning: nothing retained yet, or the role of its last turn.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The roles to insert between a state and a retained turn of a role; other pairs can't be mended by inserts.
BETWEEN = {
    (NOTHING, SYSTEM): (), (NOTHING, USER): (), (NOTHING, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: The roles to insert after the last retained turn.
ENDING = {NOTHING: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
#: Faults of a turn by number.
SOUND, BLANK, DUPLICATE, CUT = range(4)
FAULTS = (None, "blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
#: White space, and the characters that end a sentence.
WHITE, STOPS = "\x20\t\n\x0b\x0c\r", (".", "!", "?")


class Repair:
    """Chooses which turns of one conversation are retained, kept or reroled, at the least cost.

    A retained turn follows some earlier retained turn: the turns between are deleted, and what their role pair
    lacks is inserted. Deletions are priced by their prefix sum, and for each state the least price of a last
    retained turn, less the deletions up to it, is a running minimum, so that a turn looks at four prices
    whatever the gap. Of equal prices the least audit wins. All states' audits have an edit for each turn so far
    and end with one, so that none is the start of another, and what is appended keeps their order: a rank stands for
    an audit. Four bytes a turn are held, not the turns.
    """

    def __init__(self):
        self.deleted = 0
        self.price: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.steps = bytearray()  # of each turn and state: 0 if the turn is deleted, else 1 + 2 * state before + reroled

    def add(self, initial: str, fault: int) -> None:
        price = [None if p is None else p + self.deleted for p in self.price]
        extra, steps, keys = TRUNCATED * (fault == CUT), [0, 0, 0, 0], {}
        for state in STATES:
            choices = [] if price[state] is None else [(price[state] + DELETE, self.rank[state], "D", 0)]
            reroled = INITIALS.get(initial) != state
            if state != NOTHING and not (reroled and state == SYSTEM) and fault not in (BLANK, DUPLICATE):
                for before in STATES:
                    lacking = BETWEEN.get((before, state))
                    if price[before] is not None and lacking is not None:
                        cost = price[before] + INSERT * len(lacking) + REROLE * reroled + extra
                        choices.append((cost, self.rank[before], "I" * len(lacking) + "KR"[reroled], 1 + 2 * before + reroled))
            if choices:
                cost, *keys[state], steps[state] = min(choices)
                self.price[state] = cost - self.deleted - DELETE
        self.deleted += DELETE
        for place, state in enumerate(sorted(keys, key=keys.__getitem__)):
            self.rank[state] = place
        self.steps += bytes(steps)

    def decided(self) -> tuple[bytearray, tuple[int, ...]]:
        """Of each turn 0 if it is deleted, else 1 + 8 * state before + 2 * its state + reroled; and the roles to insert at the end."""
        ends = [(p + self.deleted + INSERT * len(ENDING[s]), self.rank[s], s) for s, p in enumerate(self.price) if p is not None]
        last = state = min(ends)[2]
        out = bytearray(len(self.steps) // 4)
        for i in reversed(range(len(out))):
            step = self.steps[4 * i + state]
            if step:
                before, reroled = divmod(step - 1, 2)
                out[i] = 1 + 8 * before + 2 * state + reroled
                state = before
        return out, ENDING[last]


#: Columns of the rows that tasks repair: slim ones (phase 0) decide, whole ones (phase 1) are edited.
SLIM = ("conv", "phase", "turn", "hash", "initial", "first", "ends", "empty", "role", "text")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, place, turn, edit, role, text, fault, role_before) of a task's rows, the slim ones of a conversation first."""
    repair = deciding = None
    seen: tuple | None = None
    faults, steps, end, at, place, of = bytearray(), bytearray(), (), 0, 0, None
    for batch in batches:
        for conv, phase, turn, digest, initial, first, ends, empty, role, text in zip(*(batch.column(n).to_pylist() for n in SLIM)):
            if phase == 0:
                if deciding is None:  # the first of a conversation
                    for state in end:
                        yield of, place, None, "I", ROLES[state], "", None, None
                        place += 1
                    of, place, at, end, seen, faults, deciding = conv, 0, 0, (), None, bytearray(), Repair()
                fault = BLANK if empty else DUPLICATE if not first or seen == (turn, digest) else SOUND if ends else CUT
                seen = turn, digest
                faults.append(fault)
                deciding.add(initial, fault)
                continue
            if deciding is not None:
                (steps, end), deciding = deciding.decided(), None
            step, fault = steps[at], FAULTS[faults[at]]
            at += 1
            if step:
                before, state, reroled = (step - 1) // 8, (step - 1) // 2 % 4, (step - 1) % 2
                for inserted in BETWEEN[before, state]:
                    yield conv, place, None, "I", ROLES[inserted], "", None, None
                    place += 1
                yield conv, place, turn, "KR"[reroled], ROLES[state] if reroled else role, text, fault, role
            else:
                yield conv, place, turn, "D", role, text, fault, role
            place += 1
    for state in end:
        yield of, place, None, "I", ROLES[state], "", None, None
        place += 1


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 1,000 rows, or of about a megabyte of strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == 1000 or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn, edit, role, text, fault, role_before): the edits of every conversation in order.

    The rows of a conversation are taken by turn (nulls first; of equal turns by role, then by the hash of role and text). A row is
    blank (nothing but white space), else a duplicate (role and text were there before), else truncated (its last
    visible character ends no sentence), or has no fault. Edits are K (kept), R (role becomes user or assistant), D (deleted,
    as every blank and duplicate row is) and I (a user's or assistant's turn without text is inserted). They are
    the cheapest that leave turns of the form ``(system? (user assistant)+)?``, by first letters of roles; of equally
    cheap ones those whose letters come first. A deleted row is listed with its role and text; ``turn`` and ``role_before`` of an inserted one are null.
    A null role or text counts as one space; an empty role has no first letter and can't be kept. Rows with a null
    conv_id are one conversation. Other columns are left out. An empty table gives an empty result.

    All rows of a conversation follow one another in one task, as their edits and texts depend on all
    before; the task streams them and holds some six bytes a turn. Texts are shuffled once; duplicates are found by hashes, and content that
    many rows share is counted before the shuffle.
    """
    schema, out = repaired_rows(df, conv_id, turn, role, text)

    def work(batches):
        return in_batches(edited(batches), schema)

    return out.mapInArrow(work, REPAIRED.format(out.schema["conv"].dataType.simpleString()))


REPAIRED = "conv_id {}, place long, turn long, edit string, role string, text string, fault string, role_before string"


def repaired_rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[pa.Schema, DataFrame]:
    """The Arrow form of repaired rows, and the slim and whole rows in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    name, words = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    whole = df.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), words.alias("text"))
    whole = whole.withColumn("hash", F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text")))
    shown = F.rtrim("text", F.lit(WHITE))
    slim = whole.select(
        "conv", "turn", "role", "hash", F.left("role", F.lit(1)).alias("initial"), F.right(shown, F.lit(1)).isin(*STOPS).alias("ends"), (shown == "").alias("empty")
    )
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    spread = slim.groupBy("conv", "hash").agg(F.min(order).alias("from"), F.max(order).alias("to")).where(F.col("from") != F.col("to"))
    again = spread.select(F.col("conv").alias("conv_"), F.col("hash").alias("hash_"), "from")
    marked = slim.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("hash") == F.col("hash_")), "left")
    first = F.coalesce(F.col("from") == order, F.lit(True))
    deciding = marked.select("conv", F.lit(0).alias("phase"), "turn", "hash", "initial", first.alias("first"), "ends", "empty", "role", F.lit(None).cast("string").alias("text"))
    nothing = {c: F.lit(None).cast(deciding.schema[c].dataType) for c in ("initial", "first", "ends", "empty")}
    edited_later = whole.withColumns({"phase": F.lit(1), **nothing}).select(*deciding.columns)
    rows = deciding.unionByName(edited_later).repartition("conv").sortWithinPartitions("conv", "phase", F.asc_nulls_first("turn"), "role", "hash")
    return to_arrow_schema(T._parse_datatype_string(REPAIRED.format(rows.schema["conv"].dataType.simpleString()))), rows


def reports(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row for each conversation of repaired rows that follow one another: see ``report``."""
    of, held = None, None
    for conv, turn, edit, role, text, fault, before in rows:
        if held is None or conv != of:
            if held is not None:
                yield of, *held.row()
            of, held = conv, Report()
        held.add(turn, edit, role, text, fault, before)
    if held is not None:
        yield of, *held.row()


class Report:
    def __init__(self):
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.audit = bytearray()
        self.digest, self.any = hashlib.sha256(), False

    def add(self, turn, edit, role, text, fault, before) -> None:
        self.cost += COSTS[edit] + TRUNCATED * (fault == FAULTS[CUT] and edit != "D")
        self.audit += edit.encode()
        if edit != "I":
            self.faults[fault] += 1
            if self.last is not None and self.last + before[:1] not in LEGAL:
                self.illegal += 1
            self.last = before[:1]
            if turn is not None:
                if turn != self.high:
                    self.turns += 1
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = [self.faults[f] for f in FAULTS[1:]]
        return gaps, *counts, self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


REPORTS = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of ``df``: counts of what was wrong, and cost, edits and digest of ``repair_turns``.

    gaps: turns missing between the first and the last, nulls left aside. illegal: neighbours whose roles don't follow one another. audit: the
    letters of the edits in order. repaired_sha256: of the repaired ``role:text``, joined by line feeds. The
    rows are repaired and digested in the task that has them in order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    _, rows = repaired_rows(df, conv_id, turn, role, text)
    columns = REPORTS.format(rows.schema["conv"].dataType.simpleString())
    schema = to_arrow_schema(T._parse_datatype_string(columns))

    def work(batches):
        return in_batches(reports((c, t, e, r, x, f, b) for c, _, t, e, r, x, f, b in edited(batches)), schema)

    return rows.mapInArrow(work, columns)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with a part of their rows dropped, emptied, stripped of stops, repeated or given to the user, by a fixed rule."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(code == 4, "user").otherwise(spaced("role"))
    times = F.when(code == 3, 2).when(code == 0, 0).otherwise(1)
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


#: The repair as a search over edits one by one, turn after turn, for all conversations at once.
ORACLE = r"""
WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
given AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key
  FROM conversations),
coded AS (SELECT conv, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, key), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS code
  FROM given, table_),
harmed AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE code WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) - 1 AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, role[1] AS initial FROM harmed),
turns AS (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS last,
  CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN shown[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
moves(was, becomes, lacking) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'user:'), ('s', 'u', ''), ('s', 'a', 'user:'),
  ('u', 'a', ''), ('u', 'u', 'assistant:'), ('a', 'u', ''), ('a', 'a', 'user:')),
edits AS (SELECT was, becomes, lacking, edit FROM moves, (VALUES ('K'), ('R')) e(edit) UNION ALL SELECT x, x, '', 'D' FROM (VALUES (''), ('s'), ('u'), ('a')) v(x)),
search(conv, i, state, cost, audit, done) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM turns
  UNION ALL
  SELECT s.conv, s.i + 1, e.becomes,
    s.cost + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN lacking = '' THEN 0 ELSE 2 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS c,
    s.audit || CASE WHEN lacking = '' THEN '' ELSE 'I' END || edit AS a,
    list_concat(s.done, CASE WHEN lacking = '' THEN CAST([] AS VARCHAR[]) ELSE [lacking] END, CASE edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [t.role || ':' || t.text]
      ELSE [CASE e.becomes WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text] END)
  FROM search s JOIN turns t ON t.conv = s.conv AND t.i = s.i JOIN edits e ON e.was = s.state
  WHERE edit = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate') AND CASE edit WHEN 'K' THEN t.initial = e.becomes ELSE e.becomes IN ('u', 'a') END)
  QUALIFY row_number() OVER (PARTITION BY s.conv, e.becomes ORDER BY c, a) = 1),
ends(state, more, tail, list) AS (VALUES ('', 0, '', CAST([] AS VARCHAR[])), ('s', 4, 'II', ['user:', 'assistant:']), ('u', 2, 'I', ['assistant:']), ('a', 0, '', CAST([] AS VARCHAR[]))),
facts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv),
best AS (SELECT s.conv, s.cost + e.more AS cost, s.audit || e.tail AS audit, list_concat(s.done, e.list) AS done
  FROM search s JOIN facts f ON f.conv = s.conv AND f.n = s.i JOIN ends e ON e.state = s.state
  QUALIFY row_number() OVER (PARTITION BY s.conv ORDER BY s.cost + e.more, s.audit || e.tail) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(done, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv = coalesce(CAST(c.conv_id AS VARCHAR), ' ') LEFT JOIN best b ON b.conv = f.conv"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all conversations after damage; one that has lost all its rows has zeros."""
    given = read_table(spark, sf_dir, "conversations")
    known = report(damaged(given)).withColumnRenamed("conv_id", "known")
    every = given.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("known")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
