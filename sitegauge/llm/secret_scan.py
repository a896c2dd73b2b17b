"""Operator 3: secrets in whole texts, by fixed patterns and by sliding-window entropy."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, texts
from sitegauge.sources.tables import read_table

#: Kinds of spans, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Window length in characters, and the bits a character that make a window of a class suspicious.
WINDOW = 20
CLASSES = (
    (re.compile(r"[0-9a-fA-F]+\Z"), 3.0),
    (re.compile(r"[A-Za-z0-9]+\Z"), 3.6),
    (re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.8),
)
#: Candidates that hold one of these are known not to be secrets.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)abcdefghij|0123456789",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)\A(?:sha(?:1|256|384|512)|md5)[-_=]",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; leftmost and non-overlapping for each kind.

    A match whose value is too short is dropped after it has used up its characters.
    """
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def hot_windows(word: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``word`` whose Shannon entropy is ``bits`` a character or more
    and which hold a letter and a digit.

    The sum of c * log2(c) over the window's characters is kept up to date as one character enters and
    one leaves: four terms a step, whatever the window's length.
    """
    term = [0.0] + [c * log2(c) for c in range(1, window + 2)]  # one more enters before one leaves
    counts: dict[str, int] = {}
    total = 0.0
    digits = letters = 0
    full = log2(window)
    out: list[tuple[int, int]] = []
    for i, c in enumerate(word):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            gone = word[i - window]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
            digits -= gone.isdigit()
            letters -= gone.isalpha()
        if i >= window - 1 and digits and letters and full - total / window >= bits - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    def __init__(self, window: int = WINDOW, allowed: Sequence[str] = ALLOWED):
        self.window = window
        self.allowed = [re.compile(p) for p in allowed]

    def entropy_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Hot windows that no span of ``base``, which is sorted by start, holds whole."""
        out = []
        starts, furthest = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
        for m in CANDIDATE.finditer(text):
            word = m.group()
            # A window needs a letter and a digit: words of either alone have none, and are most candidates.
            if word.isalpha() or word.isdigit() or any(p.search(word) for p in self.allowed):
                continue
            bits = next(b for p, b in CLASSES if p.match(word))
            for a, b in hot_windows(word, self.window, bits):
                a, b = a + m.start(), b + m.start()
                if furthest[bisect_right(starts, a)] < b:  # the furthest end of the spans that begin by a
                    out.append((a, 3, b))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        return sorted(base + self.entropy_spans(text, base))


def find_secrets(
    df: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    allowed: Sequence[str] = ALLOWED,
    spans: str = "secret_spans",
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end), by start and then by kind, in code points, end exclusive.

    Base kinds are assign, access and hex. Kind ``entropy`` adds the windows of long candidate strings whose
    entropy is high for the string's character class, unless the allow-list knows the string or a base
    span holds the window. Null and empty texts have no spans. Each row is scanned on its own and whole.
    """

    def start():
        scanner = Scanner(window, allowed)

        def work(column):
            return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts(column)]]

        return work

    return append_columns(df, [text], f"{spans} array<struct<kind:string,start:long,end:long>>", start, keep)


def redact_text(text: str, scanner: Scanner) -> str:
    """The text with every group of overlapping spans replaced by the kind of its first one in brackets."""
    out, end = [], 0
    merged: list[list[int]] = []
    for a, k, b in scanner.spans(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[end:a], f"[{KINDS[k]}]"]
        end = b
    return "".join([*out, text[end:]])


def redact_secrets(df: DataFrame, text: str = "text", window: int = WINDOW, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``df`` with the secrets in ``text`` replaced by their kind; null texts stay null, clean texts are unchanged."""

    def start():
        scanner = Scanner(window, allowed)
        return lambda column: [[None if t is None else redact_text(t, scanner) for t in column.to_pylist()]]

    order = df.columns
    return append_columns(df, [text], f"{text} string", start).select(*order)


def joined(kinds: Sequence[str] | None = None):
    """kind:start:end of the spans, comma-joined."""
    found = F.col("secret_spans")
    if kinds:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"),
        joined().alias("spans"),
    )


def _places(name: str, pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern with their places, which follow from the pieces between matches."""
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(found[i], '{quoted}', {group})" if group else "found[i]"
    return f"""{name} AS (SELECT row_no, value, a, a + length(found) AS b, found AS word FROM (
      SELECT row_no, {value} AS value, found[i] AS found,
        CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT row_no, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT row_no, regexp_extract_all(t, '{quoted}') AS found, string_split_regex(t, '{quoted}') AS pieces FROM docs))))"""


ORACLE = (
    r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
"""
    + ",\n".join((
        _places("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
        _places("access", "AKIA[A-Z0-9]+"),
        _places("hex", "[0-9a-f]+"),
        _places("long_", "[A-Za-z0-9+/_=-]+"),
    ))
    + r""",
base AS (
  SELECT row_no, 0 AS k, a, b FROM assign WHERE length(value) >= 6
  UNION ALL SELECT row_no, 1, a, b FROM access WHERE length(value) >= 20
  UNION ALL SELECT row_no, 2, a, b FROM hex WHERE length(value) >= 24),
words AS (SELECT row_no, a, word, CASE WHEN regexp_full_match(word, '[0-9a-fA-F]+') THEN 3.0 WHEN regexp_full_match(word, '[A-Za-z0-9]+') THEN 3.6 ELSE 3.8 END AS bits
  FROM long_ WHERE length(word) >= 20
    AND NOT regexp_matches(word, '(?i)example|sample|dummy|placeholder|changeme|abcdefghij|0123456789|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|^(?:sha(?:1|256|384|512)|md5)[-_=]')),
windows AS (SELECT row_no, a, bits, p, word[p : p + 19] AS w FROM (SELECT *, unnest(range(1, length(word) - 18)) AS p FROM words)
  WHERE regexp_matches(word[p : p + 19], '[0-9]') AND regexp_matches(word[p : p + 19], '[A-Za-z]')),
hot AS (SELECT row_no, a, p FROM windows
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: n / 20 * log2(20 / n))) >= bits - 1e-9),
islands AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY row_no, a ORDER BY p) AS island
  FROM (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY row_no, a ORDER BY p) > 20, FALSE) AS gap FROM hot)),
spans AS (SELECT row_no, a + min(p) - 1 AS a, a + max(p) + 19 AS b FROM islands GROUP BY row_no, islands.a, island),
every AS (FROM base UNION ALL
  SELECT row_no, 3, a, b FROM spans s WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.row_no = s.row_no AND x.a <= s.a AND s.b <= x.b)),
listed AS (SELECT row_no, k, a, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || b AS s FROM every),
joined AS (SELECT row_no, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM listed GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (row_no)"""
)
