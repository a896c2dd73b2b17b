"""What a page says about the business behind it: facts, their contradictions, and files drafted from them."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.json_ld import repaired
from sitegauge.functions.text import decoded, list_some, name_from_title, path_of, phone_key, truncated
from sitegauge.operators.crawlers import literals
from sitegauge.operators.page_checks import SCHEMA_REQUIRED
from sitegauge.operators.risk import steers_ai

#: Types of organisations, and of other things, that structured data are held against; a parameter, as the vocabulary grows.
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness", "ProfessionalService", "OnlineStore", "Store", "Restaurant", "Hotel", "Dentist", "Plumber", "Attorney", "School", "Hospital")
OTHER_TYPES = (
    *(t for t in SCHEMA_REQUIRED if t not in ORGANISATIONS), "Thing", "Place", "Service", "Offer", "PostalAddress", "ContactPoint", "Country", "City", "Question", "Answer", "ListItem",
    "ImageObject", "Review", "AggregateRating", "OpeningHoursSpecification", "GeoCoordinates", "SearchAction",
)
#: Properties that schema.org doesn't have, and what to use instead.
WRONG_PROPERTIES = {
    "businessHoursSpecification": "openingHoursSpecification on the business, or hoursAvailable on a ContactPoint", "businessHours": "openingHoursSpecification",
    "openingHoursSpecifications": "openingHoursSpecification", "phone": "telephone", "phoneNumber": "telephone", "website": "url", "socialProfiles": "sameAs",
    "services": "hasOfferCatalog or makesOffer",
}
#: Countries by code.
COUNTRIES = {
    "PH": "Philippines", "AU": "Australia", "US": "United States", "GB": "United Kingdom", "CA": "Canada", "NZ": "New Zealand", "SG": "Singapore", "MY": "Malaysia",
    "ID": "Indonesia", "TH": "Thailand", "VN": "Vietnam", "JP": "Japan", "KR": "South Korea", "CN": "China", "HK": "Hong Kong", "TW": "Taiwan", "IN": "India",
    "AE": "United Arab Emirates", "SA": "Saudi Arabia", "QA": "Qatar", "IL": "Israel", "DE": "Germany", "FR": "France", "ES": "Spain", "IT": "Italy", "NL": "Netherlands",
    "IE": "Ireland", "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "FI": "Finland", "CH": "Switzerland", "AT": "Austria", "BE": "Belgium", "PL": "Poland",
    "PT": "Portugal", "RU": "Russia", "UA": "Ukraine", "TR": "Turkey", "BR": "Brazil", "MX": "Mexico", "AR": "Argentina", "CL": "Chile", "CO": "Colombia",
    "ZA": "South Africa", "NG": "Nigeria", "KE": "Kenya", "EG": "Egypt",
}
ALIASES = {"usa": "US", "united states of america": "US", "uk": "GB"}
#: Names of so few letters are too often other words in prose.
LEAST_NAME = 4
#: Key pages that a page's facts list, and the letters of their labels.
PAGES, LABEL = 10, (2, 40)
CONFIRM = "TO CONFIRM: one or two sentences on what you do, for whom, and where."


def by_name() -> dict[str, str]:
    return {name.lower(): code for code, name in COUNTRIES.items()} | ALIASES


def country_code(area: Column) -> Column:
    """The code of a country given by code or name; null for others."""
    own = F.trim(area)
    codes = F.create_map(*[F.lit(x) for c in (*COUNTRIES, "UK") for x in (c, "GB" if c == "UK" else c)])
    names = F.create_map(*[F.lit(x) for pair in by_name().items() for x in pair])
    return F.when(own.rlike("^[A-Z]{2}$"), codes[own]).otherwise(names[F.lower(own)])


def countries_named_in(text: Column) -> Column:
    """Codes of the countries that a text names in whole words, sorted."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(lower.rlike(rf"\b{name.replace(' ', r'\s+')}\b"), F.lit(code)) for name, code in by_name().items() if len(name) >= LEAST_NAME]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def organisations(known: Sequence[str] = OTHER_TYPES, kinds: Sequence[str] = ORGANISATIONS) -> Column:
    """Nodes of an organisation's type, or of an unknown type with an address or a telephone."""
    unknown = lambda n: F.size(F.array_except(n["types"], literals((*known, *kinds)))) > 0
    reachable = lambda n: F.array_contains(n["filled"], "address") | F.array_contains(n["filled"], "telephone")
    return F.filter("nodes", lambda n: F.arrays_overlap(n["types"], literals(kinds)) | (unknown(n) & reachable(n)))


def key_pages() -> Column:
    """(label, url) of internal links, one for each path, with a label that says something."""
    label = lambda x: F.trim(F.regexp_replace(x["text"], "[→›»↗]+", ""))
    own = F.transform(F.filter("links", lambda x: x["internal"] & ~x["is_anchor"] & x["resolved"].isNotNull()), lambda x: F.struct(label(x).alias("label"), path_of(x["resolved"]).alias("path"), F.regexp_replace(x["resolved"], "#.*$", "").alias("url")))
    good = F.filter(own, lambda p: F.char_length(p["label"]).between(*LABEL) & ~p["label"].rlike(r"(?i)^(skip|menu|close|open|toggle|home)\b") & ~p["path"].rlike(r"(?i)\.(jpe?g|png|pdf|zip)$") & (p["path"] != path_of(F.col("url"))))
    paths = F.transform(good, lambda p: p["path"])
    first = F.filter(good, lambda p, i: F.array_position(paths, p["path"]) == i + 1)
    return F.transform(F.slice(first, 1, PAGES), lambda p: F.struct(p["label"].alias("label"), p["url"].alias("url")))


def page_business(facts: DataFrame, known: Sequence[str] = OTHER_TYPES, kinds: Sequence[str] = ORGANISATIONS) -> DataFrame:
    """page_id and name, description, phones, emails, address, hours, same_as, areas, organisations and key pages of a page.

    The first organisation of the structured data names and describes the business; else the site name, the
    title's last part or the host names it. A description that steers AI systems is left out. Lists are distinct, in order.
    """
    own = facts.withColumn("__orgs", organisations(known, kinds))
    org, every = F.get("__orgs", F.lit(0)), lambda k: F.flatten(F.transform("__orgs", lambda n: n[k]))
    meta = lambda k: F.nullif(F.element_at("metas", k), F.lit(""))
    host = F.regexp_replace(F.regexp_extract("url", r"://([^/?#:]*)", 1), r"^www\.", "")
    told = F.coalesce(org["description"], meta("description"))
    mails = F.transform(F.concat(every("emails"), F.transform("mails", decoded)), lambda e: F.lower(F.trim(e)))
    return own.select(
        "page_id", F.coalesce(org["name"], meta("og:site_name"), name_from_title(F.col("title")), F.nullif(host, F.lit(""))).alias("name"),
        F.when(~steers_ai(told), told).alias("description"), F.array_distinct(F.concat(every("phones"), F.transform("tels", decoded))).alias("phones"),
        F.array_distinct(F.filter(mails, lambda e: e.contains("@"))).alias("emails"), org["address"].alias("address"), F.coalesce(org["hours"], F.array().cast("array<string>")).alias("hours"),
        F.array_distinct(every("same_as")).alias("same_as"), F.array_distinct(every("areas")).alias("areas"), F.size("__orgs").alias("organisations"), key_pages().alias("pages"),
    )


def phone_numbers(phones: Column, llms: Column) -> Column:
    """The numbers of a page and of its llms.txt that differ in their last nine digits, each as first spelled."""
    more = F.regexp_extract_all(F.coalesce(llms, F.lit("")), F.lit(r"(\+\d[\d\s().-]{7,}\d)"), 1)
    every = F.filter(F.concat(phones, F.transform(more, F.trim)), lambda p: phone_key(p).isNotNull())
    keys = F.transform(every, phone_key)
    return F.filter(every, lambda p, i: F.array_position(keys, phone_key(p)) == i + 1)


def unnamed_countries(areas: Column, llms: Column) -> Column:
    """Countries of the structured data that llms.txt doesn't name, where it names some."""
    codes = F.array_distinct(F.array_compact(F.transform(areas, country_code)))
    named = countries_named_in(llms)
    return F.when((F.size(named) > 0), F.array_except(codes, named)).otherwise(F.array().cast("array<string>"))


def schema_problems(known: Sequence[str] = OTHER_TYPES, kinds: Sequence[str] = ORGANISATIONS) -> tuple[Column, Column]:
    """Types of the nodes that the vocabulary lacks, and properties that schema.org doesn't have; both distinct."""
    types = F.array_distinct(F.flatten(F.transform("nodes", lambda n: n["types"])))
    keys = F.array_distinct(F.flatten(F.transform("nodes", lambda n: n["keys"])))
    return F.array_except(types, literals((*known, *kinds))), F.array_intersect(keys, literals(WRONG_PROPERTIES))


def business_findings(facts: DataFrame, llms: DataFrame, known: Sequence[str] = OTHER_TYPES, kinds: Sequence[str] = ORGANISATIONS) -> DataFrame:
    """page_id, finding, impact, effort, area, ord, detail of what contradicts itself or is misnamed.

    ``llms`` has page_id and text of the pages whose llms.txt is a text file.
    """
    strange, wrong = schema_problems(known, kinds)
    rows = facts.select("page_id", "text", F.size("json_ld").alias("blocks"), "json_ld_broken", strange.alias("strange"), wrong.alias("wrong"))
    rows = rows.join(page_business(facts, known, kinds), "page_id").join(llms.select("page_id", F.col("text").alias("llms")), "page_id", "left")
    phones, areas = phone_numbers(F.col("phones"), F.col("llms")), unnamed_countries(F.col("areas"), F.col("llms"))
    days = r"(?i)\b(mon(day)?|tue(sday)?|wed(nesday)?|thu(rsday)?|fri(day)?|sat(urday)?|sun(day)?|hours|open)\b"
    steered = F.filter(F.split(F.coalesce("llms", F.lit("")), r"\r?\n"), steers_ai)
    blocks = F.col("blocks") - F.col("json_ld_broken") > 0
    tests = [
        ("facts.phones", "medium", "facts", F.size(phones) > 1, F.array_join(phones, " · ")),
        ("facts.area_served", "medium", "facts", F.size(areas) > 0, F.array_join(areas, ",")),
        ("facts.hours_hidden", "low", "facts", (F.size("hours") > 0) & ~F.col("text").rlike(days), F.array_join("hours", "; ")),
        ("schema.no_org", "medium", "schema", blocks & (F.col("organisations") == 0), F.lit("")),
        ("schema.vocabulary", "medium", "schema", blocks & ((F.size("strange") > 0) | (F.size("wrong") > 0)), list_some(F.concat("strange", "wrong"), 6, "name")),
        ("llms.steering", "medium", "llms", F.size(steered) > 0, F.array_join(F.slice(steered, 1, 5), "\n")),
    ]
    fields = lambda n, f, i, a, d: F.struct(F.lit(f).alias("finding"), F.lit(i).alias("impact"), F.lit("small").alias("effort"), F.lit(a).alias("area"), F.lit(n).alias("ord"), d.alias("detail"))
    found = F.array_compact(F.array(*[F.when(t, fields(n, f, i, a, d)) for n, (f, i, a, t, d) in enumerate(tests)]))
    return rows.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*")


def llms_drafts(business: DataFrame, origins: DataFrame) -> DataFrame:
    """page_id, content: an llms.txt of known facts only; what isn't known is left to confirm. ``origins`` has page_id and origin."""
    first = lambda c: F.get(c, F.lit(0))
    line = lambda label, value, otherwise="TO CONFIRM": F.concat(F.lit(f"- {label}: "), F.coalesce(value, F.lit(otherwise)))
    hours = F.when(F.size("hours") > 0, F.array_join("hours", "; "))
    pages = F.transform("pages", lambda p: F.concat(F.lit("- ["), F.translate(p["label"], "[]", ""), F.lit("]("), p["url"], F.lit(")")))
    host = lambda s: F.regexp_replace(F.regexp_extract(s, r"://([^/?#:]*)", 1), r"^www\.", "")
    profiles = F.transform(F.slice("same_as", 1, 8), lambda s: F.concat(F.lit("- ["), F.coalesce(F.nullif(host(s), F.lit("")), s), F.lit("]("), s, F.lit(")")))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce("name", F.lit("TO CONFIRM: business name"))), F.lit(""), F.concat(F.lit("> "), F.when(F.coalesce("description", F.lit("")) != "", truncated(F.col("description"), 300)).otherwise(CONFIRM)), F.lit("")),
        F.array(F.lit("## Contact"), line("Phone", first("phones")), line("Email", first("emails")), line("Address", F.col("address"), 'TO CONFIRM (or say "online only")'), line("Hours", hours)),
        F.array(F.lit("- Service area: TO CONFIRM (name the towns or countries)"), F.lit(""), F.lit("## Key pages"), F.concat(F.lit("- [Home]("), F.col("origin"), F.lit("/)"))), pages,
        F.when(F.size("same_as") > 0, F.concat(F.array(F.lit(""), F.lit("## Profiles")), profiles)).otherwise(F.array().cast("array<string>")),
    )
    return business.join(origins, "page_id").select("page_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def repaired_llms(files: DataFrame, business: DataFrame) -> DataFrame:
    """page_id, content, removed: an llms.txt without lines that steer AI systems, with links and a summary line.

    ``files`` has page_id and text.
    """
    lines = F.split("text", r"\r?\n")
    linked = lambda line: F.regexp_replace(line, r"^(\s*[-*]\s+)([^:\[\]]{1,79}[^:\[\]\s])\s*:\s+(https?://\S+?)\s*$", "$1[$2]($3)")
    rows = files.join(business.select("page_id", "name", "description"), "page_id", "left")
    rows = rows.withColumns({"removed": F.filter(lines, steers_ai), "kept": F.transform(F.filter(lines, lambda x: ~steers_ai(x)), linked)})
    summary = F.concat(F.lit("> "), F.when(F.coalesce("description", F.lit("")) != "", truncated(F.col("description"), 300)).otherwise(CONFIRM))
    heading = F.array_position(F.transform("kept", lambda x: x.rlike(r"^#\s+\S")), True).cast("int")
    title = F.concat(F.lit("# "), F.coalesce("name", F.lit("TO CONFIRM: business name")))
    whole = (
        F.when(F.exists("kept", lambda x: x.rlike(r"^>\s+\S")), F.col("kept"))
        .when(heading > 0, F.concat(F.slice("kept", F.lit(1), heading), F.array(F.lit(""), summary), F.slice("kept", heading + 1, F.greatest(F.size("kept") - heading, F.lit(0)))))
        .otherwise(F.concat(F.array(title, F.lit(""), summary, F.lit("")), F.col("kept")))
    )
    text = F.regexp_replace(F.regexp_replace(F.array_join(whole, "\n"), r"\n{3,}", "\n\n"), r"\s+$", "")
    return rows.select("page_id", F.concat(text, F.lit("\n")).alias("content"), F.transform("removed", lambda x: truncated(x, 200)).alias("removed"))


def organisation_schema(business: DataFrame, origins: DataFrame) -> DataFrame:
    """page_id, content: the JSON-LD of an organisation from known facts; unknown ones are left out."""
    first = lambda c: F.get(c, F.lit(0))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), F.concat("origin", F.lit("/#organization")).alias("@id"), F.col("name"),
        F.concat("origin", F.lit("/")).alias("url"), F.when(F.col("description") != "", truncated(F.col("description"), 300)).alias("description"), first("phones").alias("telephone"), first("emails").alias("email"),
        F.when(F.size("same_as") > 0, F.slice("same_as", 1, 10)).alias("sameAs"),
    )
    return business.join(origins, "page_id").select("page_id", F.to_json(node).alias("content"))


#: Properties that only need another name.
RENAMES = {
    "businessHoursSpecification": "openingHoursSpecification", "businessHours": "openingHoursSpecification", "openingHoursSpecifications": "openingHoursSpecification",
    "phone": "telephone", "phoneNumber": "telephone", "website": "url", "socialProfiles": "sameAs",
}


def repaired_schema(facts: DataFrame, known: Sequence[str] = OTHER_TYPES, kinds: Sequence[str] = ORGANISATIONS) -> DataFrame:
    """page_id, content: every block of a page with unknown types or wrong properties, corrected. One Arrow map, no shuffle."""
    strange, wrong = schema_problems(known, kinds)
    rows = facts.where((F.size(strange) > 0) | (F.size(wrong) > 0)).select("page_id", F.explode("json_ld").alias("block"))
    types = {*known, *kinds}

    def run(batches):
        for batch in batches:
            pairs = [(b, repaired(b, types, RENAMES)) for b in batch.column(1).to_pylist()]
            changed = [n is not None and json.loads(n) != json.loads(b) for b, n in pairs]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in pairs], pa.string())], names=["page_id", "content"])
            yield made.filter(pa.array(changed, pa.bool_()))

    return rows.mapInArrow(run, f"page_id {facts.schema['page_id'].dataType.simpleString()}, content string")
