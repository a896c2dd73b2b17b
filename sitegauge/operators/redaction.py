"""Page text made safe to hand on: sentences that address AI systems are taken out, code can't leave its fence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import REDACTED, clipped, flattened, once
from sitegauge.operators.risk import addresses_ai, ai_sentence, steers_ai

#: Sentences that are cut out of one text; a text that still addresses an AI system then is replaced as a whole.
ROUNDS = 5
FENCE, QUOTES = "```", "'''"


def without(text: Column, part: Column) -> Column:
    """The text with the first occurrence of a part redacted; all of it, should the part not be found."""
    at = F.position(part, text)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(REDACTED), F.substring(text, at + F.char_length(part), F.char_length(text)))
    return F.when(at == 0, REDACTED).otherwise(cut)


def one_sentence_less(text: Column) -> Column:
    """The text without its first sentence that addresses an AI system; without such a sentence as it is."""
    return once(ai_sentence(text), lambda hit: F.when(hit.isNull(), text).otherwise(once(F.regexp_replace(hit, "…$", ""), lambda part: without(text, part))))


def cleaned(text: Column, n: int = 200) -> Column:
    """One line of at most ``n`` characters without the sentences that address AI systems.

    Up to ROUNDS sentences are cut, each search on what the one before has left: a fold that carries the text. A text that
    steers a reader without addressing one, or that has further such sentences, is redacted as a whole. Null gives the empty text. Texts
    without a match, nearly all, don't enter the fold.
    """

    def finished(own: Column) -> Column:
        return clipped(F.when((own != REDACTED) & steers_ai(own), REDACTED).otherwise(own), n)

    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
    return once(flattened(text), lambda flat: F.when(steers_ai(flat), once(F.aggregate(rounds, flat, lambda own, _: one_sentence_less(own)), finished)).otherwise(clipped(flat, n)))


def safe_snippet(code: Column) -> Column:
    """Code that can be put between fences: lines that address AI systems are redacted, and no line holds a fence.

    Whether the code itself opens fences, closes them or nests longer ones, none is left, so that the text around it stays
    outside. Other lines keep every character. Null gives the empty text.
    """
    lines = F.split(F.coalesce(code, F.lit("")), "\n")
    return F.array_join(F.transform(lines, lambda line: F.when(addresses_ai(line), REDACTED).otherwise(F.replace(line, F.lit(FENCE), F.lit(QUOTES)))), "\n")
