"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is read."""
    return F.transform(F.array(value), use)[0]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    """White space collapsed; longer texts end with an ellipsis at ``n`` characters."""
    own = collapsed(text)
    return F.when(F.char_length(own) > n, F.concat(F.substring(own, 1, n - 1), F.lit("…"))).otherwise(own)


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.2f MB", n / (1024 * 1024)))
    )


def pixel_width(text: Column) -> Column:
    return F.floor(F.char_length(text) * 8.5 + 0.5)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three letters or more, of a-z, 0-9 and U+00C0 to U+024F."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9À-ɏ]+"), lambda w: F.char_length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def phone_key(text: Column) -> Column:
    """The last nine digits of a number of seven digits or more."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.char_length(digits) >= 7, F.right(digits, F.lit(9)))


def is_private_ip(ip: Column) -> Column:
    """Loopback, private, link-local, shared, unspecified, multicast and reserved addresses of either version."""
    octets = F.split(F.regexp_replace(F.lower(ip), r"^::ffff:", ""), r"\.")
    a, b = [F.try_element_at(octets, F.lit(i)).try_cast("int") for i in (1, 2)]
    v4 = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    )
    v6 = F.lower(ip).rlike("^(::|::1|fe80.*|f[cdf].*)$")
    return F.when(F.size(octets) == 4, F.coalesce(v4, F.lit(True))).otherwise(v6)


def slug(text: Column) -> Column:
    """Lower case, what is no letter or digit of a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def normalized_url(url: Column) -> Column:
    """A url with a scheme (https where it has none) and without its fragment; null for a blank one."""
    own = F.trim(url)
    return F.when(own != "", F.regexp_replace(F.when(own.rlike("(?i)^https?://"), own).otherwise(F.concat(F.lit("https://"), own)), "#.*$", ""))


def path_of(url: Column) -> Column:
    """The path without slashes at its end; ``/`` for the root, and a text that is no url as it is."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(path == "", "/").otherwise(path)).otherwise(url)


def list_some(items: Column, n: int, noun: str) -> Column:
    """The distinct items, comma-joined; beyond ``n`` the number of the others."""
    own = F.array_distinct(items)
    more = F.size(own) - n
    rest = F.concat(F.array_join(F.slice(own, 1, n), ", "), F.lit(" and "), more.cast("string"), F.lit(f" more {noun}"), F.when(more == 1, "").otherwise("s"))
    return F.when(more > 0, rest).otherwise(F.array_join(own, ", "))


def decoded(text: Column) -> Column:
    """Per cent escapes decoded, a plus kept; a text whose escapes are broken as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


#: Control, zero-width, line-separating and direction-changing characters.
INVISIBLE = r"[\x00-\x1F\x7F\u200B-\u200F\u2028\u2029\u202A-\u202E\u2066-\u2069]"
REDACTED = "[redacted: page text addressed to AI systems — see risk flags]"


def flattened(text: Column) -> Column:
    """One line that can't break out of a table or a code span: invisible characters are spaces, marks are replaced."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, " "), "`|", "'/")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def clipped(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def evidence(text: Column, n: int = 160) -> Column:
    """Quoted page text with its words joined by dots, so that it can't be read as an instruction."""
    return F.concat(F.lit("UNTRUSTED⟦"), F.array_join(F.split(clipped(flattened(text), n), " "), "·"), F.lit("⟧"))


def age_in_days(time: Column, now: Column) -> Column:
    """Whole days between two timestamps, rounded half up."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(time)) / 86_400 + 0.5)


def name_from_title(title: Column) -> Column:
    """The last part of a title that a bar, dash or middle dot parts; null for one part."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s[|–—-]\s|\s·\s"), F.trim), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))
