"""Spam and machine-directed text as flags of pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.text import collapsed, jaccard, once, slug, truncated, word_set
from sitegauge.functions.urls import origins

#: Terms and patterns of text that addresses AI systems, and of link spam.
AI_TERMS = (
    r"(?:ai|a\.i\.|llms?|large language models?|language models?|chat ?bots?|ai assistants?|ai agents?|"
    r"assistants?|chatgpt|claude|gemini|copilot|perplexity|crawlers?|bots?)"
)
VERBS = "(?:mention|say|recommend|describe|state|list|answer|respond|rank|cite|suggest|prefer|treat|consider|tell)"
DIRECTIVE = rf"(?:you\s+(?:must|should|will|are|need)|do not|don't|never\s+{VERBS}|always\s+{VERBS}|{VERBS}|ignore|disregard)"
AI_ADDRESSES = (
    rf"(?i)\b(?:note|message|instructions?|notice|memo)\s+(?:to|for)\s+(?:all\s+|any\s+|the\s+)?{AI_TERMS}\b",
    rf"(?i)\b(?:attention|dear|hey|hi|hello)\s*,?\s+(?:all\s+|any\s+|the\s+)?{AI_TERMS}\b",
    rf"(?i)(?:^|[.!?;\n(]\s*)(?:the\s+|all\s+|any\s+)?{AI_TERMS}\s*[:,]\s*(?:please\s+)?{DIRECTIVE}\b",
    rf"(?i)\bif you(?:'re| are)\s+(?:an?\s+)?{AI_TERMS}\b",
    r"(?i)\bwhen (?:asked|prompted|users? asks?|someone asks|people ask)\b[^.!?\n]{0,120}\b(?:recommend|say|answer|respond|mention|describe|rank|suggest)\b",
    r"(?i)\b(?:ignore|disregard)\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier|other)\s+(?:instructions|prompts|directions|rules)\b",
)
SPAM_TERMS = (
    r"(?i)\b(?:casinos?|poker|slots?|betting|sportsbook|viagra|cialis|levitra|online pharmacy|payday loans?|replica watches|escorts?|porn|xxx)\b"
)
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she "
    "too use that with have this will your from they know want been good much some time very when come here just like long make many more only over such "
    "take than them well were what into also each about which their there would could other these those then because while where after before being through"
).split()
WORD_BREAK = "[^a-z0-9À-ɏ]+"
LEAST_WORDS, LEAST_DENSITY, LEAST_TIMES = 150, 0.06, 15
#: Foreign hosts from which hidden links are a scheme; pieces of evidence that a flag shows.
SCHEME_HOSTS, EVIDENCE = 8, 5
#: Hosts that hidden menus link to, and phrases that steer what an AI system recommends.
SOCIAL_HOSTS = (
    r"(?i)(?:^|\.)(?:facebook|fb|instagram|twitter|x|linkedin|youtube|youtu|tiktok|pinterest|github|wa|whatsapp|t|telegram|threads|medium|discord|apps\.apple|play\.google)"
    r"\.(?:com|me|be|net|org|gg)$"
)
AI_WHO = r"(?:you|assistants?|ai(?:\s+(?:assistants?|systems?|models?|tools?))?|llms?|language\s+models?|agents?|chatbots?|crawlers?)"
STEERING = (
    r"(?i)\b(?:when|if|whenever)\s+(?:you\s+are\s+|you're\s+)?(?:answering|responding\s+to|replying\s+to)\b",
    r"(?i)\b(?:when|if|whenever)\s+(?:you\s+are\s+|you're\s+)?asked\s+(?:about|which|who|what|for\s+(?:a|the)\s+(?:best|top|recommended))\b",
    r"(?i)\bfor\s+any\s+(?:query|question|request|search)\s+(?:about|on|regarding)\b",
    r"(?i)\bthe\s+(?:correct|right|only)\s+(?:entity|answer)\s+is\b",
    r"(?i)\bthe\s+correct\s+(?:company|business|provider|result|choice)\s+is\b",
    rf"(?i)\b{AI_WHO}\s+(?:should|must|need\s+to|are\s+(?:asked|instructed)\s+to)\s+(?:always\s+)?(?:recommend|suggest|mention|cite|rank|say|state|answer|read|treat)\b",
    r"(?i)\b(?:every|any|all)\s+(?:ai\s+)?(?:agents?|assistants?|crawlers?|llms?|models?)\s+should\b",
)


def addresses_ai(text: Column) -> Column:
    """Whether a text of eight characters or more addresses an AI system, rather than mentions one."""
    own = collapsed(text)
    found = F.lit(False)
    for p in AI_ADDRESSES:
        found = found | own.rlike(p)
    return (F.char_length(own) >= 8) & found


def ai_sentence(text: Column) -> Column:
    """The sentence that addresses an AI system, of 200 characters at most; null without one.

    Of several patterns the first in order of the list decides, by its first match. The sentence begins after the full stop, exclamation or
    question mark before the match, and ends with the next one that white space or the end follows.
    """

    def found(own: Column) -> Column:
        first = F.when(F.char_length(own) < 8, F.lit(None).cast("string"))
        for p in AI_ADDRESSES:
            first = first.when(own.rlike(p), truncated(sentence_around(own, p), 200))
        return first

    return once(collapsed(text), found)


def sentence_around(own: Column, pattern: str) -> Column:
    """The sentence of the pattern's first match; a mark with which the match begins ends the sentence before."""
    match = F.regexp_extract(own, pattern, 0)

    def cut(at: Column) -> Column:
        lead = F.char_length(F.regexp_extract(match, r"^[.!?;\n(]\s*", 0))
        before = F.regexp_extract(F.substring(own, F.lit(1), at - 1 + lead), "^(?:.*[.!?])?(.*)$", 1)
        rest = F.substring(own, at + F.char_length(match), F.char_length(own))
        end = F.when(rest.rlike(r"[.!?](?:\s|$)"), F.regexp_extract(rest, r"^(.*?[.!?])(?:\s|$)", 1)).otherwise(rest)
        return F.concat(before, F.substring(match, lead + 1, F.char_length(match)), end)

    return once(F.regexp_instr(own, F.lit(pattern)), cut)


def steers_ai(text: Column) -> Column:
    """Whether a line of twelve characters or more tells a reader what to recommend or which answer is right."""
    own = collapsed(text)
    found = addresses_ai(own)
    for p in STEERING:
        found = found | own.rlike(p)
    return (F.char_length(own) >= 12) & found


def top_terms(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, words, term, times of the most frequent content word of each text; of equals the first to occur.

    A text's words never leave its row: one Arrow map counts them, without a shuffle. Texts without content words give no row;
    rows of one key are texts of their own.
    """
    names = pages.select(key).schema.add("words", "long").add("term", "string").add("times", "long")
    word, stop = re.compile(WORD_BREAK.replace("[^", "[")), frozenset(STOP_WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, terms, times = [], [], [], []
            for row, own in enumerate(batch.column(1).to_pylist()):
                counts = Counter(w for w in word.findall((own or "").lower()) if len(w) >= 4 and w not in stop)  # in order of first occurrence
                if counts:
                    term = max(counts, key=counts.__getitem__)
                    rows.append(row)
                    words.append(counts.total())
                    terms.append(term)
                    times.append(counts[term])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names.names)

    return pages.select(key, text).mapInArrow(count, names)


def keyword_stuffing(terms: DataFrame) -> DataFrame:
    return terms.where((F.col("words") >= LEAST_WORDS) & (F.col("times") / F.col("words") > LEAST_DENSITY) & (F.col("times") >= LEAST_TIMES))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def said(elements: Column, text, where) -> Column:
    """(where, text) of the elements that address an AI system."""
    return F.filter(F.transform(elements, lambda x: F.struct(where(x).alias("where"), ai_sentence(text(x)).alias("text"))), lambda e: e["text"].isNotNull())


def first_texts(evidence: Column) -> Column:
    """Evidence without repeated texts, the first of each kept, EVIDENCE at most."""
    texts = F.transform(evidence, lambda e: e["text"])
    return F.slice(F.filter(evidence, lambda e, i: F.array_position(texts, e["text"]) == i + 1), 1, EVIDENCE)


def page_flags(facts: DataFrame, rendered_hidden: DataFrame | None = None) -> DataFrame:
    """page_id, flag, severity, evidence and rank of the flags that a page's own text gives, the severest first.

    Concealed elements are those of the HTML and, where there is a render, those of ``rendered_hidden`` (page_id,
    hidden, and where the render ended, final_url). Links to a page's own host or its subdomains are not foreign, and links to social networks are no scheme.
    """
    named = lambda hidden, source: F.transform(hidden, lambda h: F.struct(F.lit(source).alias("source"), h["reason"].alias("reason"), h["tag"].alias("tag"), h["text"].alias("text"), h["links"].alias("links")))
    if rendered_hidden is None:
        facts = facts.withColumn("hidden", named("hidden", "raw HTML"))
    else:
        last = F.max("final_url") if "final_url" in rendered_hidden.columns else F.lit(None).cast("string")
        more = rendered_hidden.groupBy("page_id").agg(F.flatten(F.collect_list("hidden")).alias("__more"), last.alias("__end"))
        joined = facts.withColumn("hidden", named("hidden", "raw HTML")).join(more, "page_id", "left")
        away = (origins(F.col("__end")) != origins(F.col("url")))
        end = F.when(away, F.array(F.struct(F.lit("after JavaScript ran, the browser ended up at").alias("where"), F.col("__end").alias("target"))))
        joined = joined.withColumn("redirects", F.concat("redirects", F.coalesce(end, F.array_except("redirects", "redirects"))))
        facts = joined.withColumn("hidden", F.concat("hidden", F.coalesce(named("__more", "rendered page"), F.array_except("hidden", "hidden"))))
    here = host_of(F.col("url"))
    foreign = lambda u: (host_of(u) != "") & (host_of(u) != here) & ~F.endswith(host_of(u), F.concat(F.lit("."), here))
    spammy = lambda x: F.concat_ws(" ", x["text"], x["href"]).rlike(SPAM_TERMS)
    shown = lambda where, x: F.struct(where.alias("where"), F.concat(F.coalesce(F.nullif(x["text"], F.lit("")), F.lit("(no text)")), F.lit(" → "), x["href"]).alias("text"))
    concealed = lambda h: F.concat(h["source"], F.lit(": <"), h["tag"], F.lit("> hidden by "), h["reason"])
    pairs = F.flatten(F.transform("hidden", lambda h: F.transform(F.filter(h["links"], lambda x: foreign(x["href"])), lambda x: F.struct(concealed(h).alias("where"), x["href"].alias("href"), x["text"].alias("text")))))
    staged = facts.withColumn("__pairs", pairs).select(
        "page_id", "title", "redirects",
        said(F.col("hidden"), lambda h: h["text"], concealed).alias("told"),
        said(F.col("comments"), lambda c: c, lambda c: F.lit("HTML comment")).alias("noted"),
        F.concat(
            said(F.map_values("metas"), lambda v: v, lambda v: F.lit("meta")), said(F.col("labels"), lambda v: v, lambda v: F.lit("attribute")),
            said(F.col("json_strings"), lambda v: v, lambda v: F.lit("JSON-LD structured data")),
        ).alias("marked"),
        F.transform(F.filter("__pairs", spammy), lambda x: shown(x["where"], x)).alias("hidden_spam"),
        F.filter("__pairs", lambda x: ~spammy(x) & ~host_of(x["href"]).rlike(SOCIAL_HOSTS)).alias("schemes"),
        F.transform(
            F.filter("links", lambda x: (host_of(F.coalesce(x["resolved"], F.lit(""))) != "") & (host_of(x["resolved"]) != here) & F.concat_ws(" ", x["text"], x["resolved"]).rlike(SPAM_TERMS)),
            lambda x: F.struct(F.lit("link").alias("where"), F.concat(F.coalesce(F.nullif(x["text"], F.lit("")), F.lit("(no text)")), F.lit(" → "), x["resolved"]).alias("text")),
        ).alias("spam"),
    )
    every_host = F.transform("schemes", lambda x: host_of(x["href"]))
    hosts, first_of_hosts = F.array_distinct(every_host), F.filter("schemes", lambda x, i: F.array_position(every_host, host_of(x["href"])) == i + 1)
    machine = F.concat("noted", "marked")
    title_words = F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: (F.char_length(w) >= 4) & ~w.isin(*STOP_WORDS))
    repeated = F.filter(F.array_distinct(title_words), lambda w: F.size(F.filter(title_words, lambda x: x == w)) >= 3)
    any_ = lambda c: F.size(c) > 0
    flags = [
        ("risk.hidden_ai_instructions", F.when(any_("told"), "critical"), F.col("told")),
        ("risk.hidden_spam_links", F.when(any_("hidden_spam"), "critical"), F.col("hidden_spam")),
        ("risk.hidden_external_links", F.when(F.size(hosts) >= SCHEME_HOSTS, "warning"), F.transform(first_of_hosts, lambda x: shown(x["where"], x))),
        ("risk.machine_only_ai_text", F.when(any_("noted"), "critical").when(any_("marked"), "warning"), machine),
        ("risk.spam_links", F.when(any_("spam") & ~any_("hidden_spam"), "warning"), F.col("spam")),
        ("risk.sneaky_redirect", F.when(any_("redirects"), "warning"), F.transform("redirects", lambda r: F.struct(r["where"].alias("where"), r["target"].alias("text")))),
        ("risk.title_stuffing", F.when(any_(repeated), "notice"), F.transform(repeated, lambda w: F.struct(F.lit("title").alias("where"), w.alias("text")))),
    ]
    rows = [F.when(s.isNotNull(), F.struct(F.lit(i).alias("ord"), F.lit(f).alias("flag"), s.alias("severity"), first_texts(e).alias("evidence"))) for i, (f, s, e) in enumerate(flags)]
    found = staged.select("page_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("page_id", "f.*")
    return ranked_flags(found).drop("ord")


def ranked_flags(flags: DataFrame, by: str = "page_id") -> DataFrame:
    """``flags`` with their rank within each page: critical, warning, notice, and then in their own order (``ord``)."""
    severity = F.array_position(F.array(*map(F.lit, ("critical", "warning", "notice"))), F.col("severity"))
    return flags.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(severity, "ord", "flag")))


def risk_status(pages: DataFrame, flags: DataFrame, by: str = "page_id") -> DataFrame:
    """page_id, status: high with a critical flag, review with another one that is no notice, else clean."""
    worst = flags.groupBy(by).agg(F.bool_or(F.col("severity") == "critical").alias("c"), F.bool_or(F.col("severity") == "warning").alias("w"))
    return pages.select(by).join(worst, by, "left").select(by, F.when(F.col("c"), "high").when(F.col("w"), "review").otherwise("clean").alias("status"))


def variant_flags(base: DataFrame, variants: DataFrame) -> DataFrame:
    """page_id, flag, severity, similarity, evidence of what other crawlers get.

    ``base`` has page_id, url, status, text and title; ``variants`` page_id, label, status, text, title, final_url, flag_blocking and error. A
    variant that could not be fetched (an error, or no status) proves nothing. One refused (400 and above) where visitors are not is blocked, unless flag_blocking is
    false; one that ends on another origin, or shares less than 0.6 of the words, is cloaking, critical below 0.3 or on another origin. Its evidence is the share of
    words, the titles where they differ, and the other address.
    """
    nothing = F.lit(None).cast("string")
    name = lambda df, c: F.coalesce(F.trim(c), F.lit("")) if c in df.columns else F.lit("")
    own = base.select("page_id", origins(F.col("url")).alias("__origin"), F.col("status").alias("__status"), word_set(F.coalesce("text", F.lit(""))).alias("__words"), name(base, "title").alias("__title"))
    fetched = variants.withColumns({"title": name(variants, "title"), "error": F.col("error") if "error" in variants.columns else nothing}).where("status is not null and error is null")
    joined = fetched.join(own, "page_id").withColumn("similarity", jaccard(word_set(F.coalesce("text", F.lit(""))), F.col("__words")))
    joined = joined.withColumns({
        "refused": (F.col("status") >= 400) & (F.coalesce("__status", F.lit(0)) < 400),
        "away": (F.coalesce("final_url", F.lit("")) != "") & F.col("__origin").isNotNull() & ~origins(F.col("final_url")).eqNullSafe(F.col("__origin")),
    })
    refused, away, retitled = F.col("refused"), F.col("away"), F.col("title") != F.col("__title")
    severity = F.when(refused, F.when(F.coalesce("flag_blocking", F.lit(True)), "warning")).when(away | (F.col("similarity") < 0.3), "critical").when(F.col("similarity") < 0.6, "warning")
    flag = F.concat(F.when(refused, "risk.blocked.").otherwise("risk.cloaking."), slug(F.col("label")))
    piece = lambda where, text: F.struct(where.alias("where"), text.alias("text"))
    shared = F.concat(F.floor(F.col("similarity") * 100 + 0.5).cast("string"), F.lit("% of words shared with what visitors get"))
    pieces = F.array(
        piece(F.lit("content similarity"), shared), F.when(retitled, piece(F.concat(F.lit("title for "), "label"), truncated(F.col("title"), 120))),
        F.when(retitled, piece(F.lit("title for visitors"), truncated(F.col("__title"), 120))), F.when(away, piece(F.concat("label", F.lit(" ends up at")), F.col("final_url"))),
    )
    evidence = F.when(refused, F.array().cast("array<struct<where:string,text:string>>")).otherwise(F.array_compact(pieces))
    found = joined.select("page_id", flag.alias("flag"), severity.alias("severity"), F.when(~refused, F.col("similarity")).alias("similarity"), evidence.alias("evidence"))
    return found.where("severity is not null")
