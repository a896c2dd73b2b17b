"""Nodes and strings of a page's JSON-LD blocks. A small helper of ``html_facts``."""

from __future__ import annotations

import json
from collections.abc import Iterator


def not_json(name: str):
    raise ValueError(name)


def parsed(blocks: list[str]) -> tuple[list, int]:
    """The blocks that are JSON, and how many are not."""
    out, broken = [], 0
    for text in blocks:
        try:
            out.append(json.loads(text, parse_constant=not_json))
        except (ValueError, RecursionError):
            broken += 1
    return out, broken


def values_of(value) -> Iterator:
    """The value and all that it holds, each before its parts."""
    stack = [value]
    while stack:
        own = stack.pop()
        yield own
        inner = own if isinstance(own, list) else list(own.values()) if isinstance(own, dict) else []
        stack.extend(reversed(inner))


def listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def strings(value) -> list[str]:
    return [x for x in listed(value) if isinstance(x, str)]


def hours_of(node: dict) -> list[str]:
    """Opening hours in one line for each specification, then those that are text already."""
    out = []
    for spec in listed(node.get("openingHoursSpecification")):
        if isinstance(spec, dict) and spec.get("opens") and spec.get("closes"):
            days = ", ".join(str(d).rsplit("schema.org/", 1)[-1] for d in listed(spec.get("dayOfWeek")))
            out.append(f"{days}: {spec['opens']}–{spec['closes']}")
    return out + strings(node.get("openingHours"))


def address_of(node: dict) -> str | None:
    for own in listed(node.get("address"))[:1]:
        if isinstance(own, str):
            return own
        if isinstance(own, dict):
            parts = [own.get(k) for k in ("streetAddress", "addressLocality", "postalCode", "addressCountry")]
            return ", ".join(p for p in parts if isinstance(p, str) and p.strip()) or None
    return None


def area_name(area) -> str:
    return str(area.get("name") or area.get("@id") or "") if isinstance(area, dict) else str(area)


def described(node: dict) -> dict:
    """What the checks and findings read of a node; a value that is null or an empty text is not filled in."""
    questions = [q.get("name") for q in node["mainEntity"] if isinstance(q, dict)] if isinstance(node.get("mainEntity"), list) else []
    contacts = [c for c in listed(node.get("contactPoint")) if isinstance(c, dict)]
    text = lambda k: node[k] if isinstance(node.get(k), str) else None
    return {
        "types": [str(t).rsplit("schema.org/", 1)[-1] for t in listed(node["@type"])],
        "keys": [k for k in node if not k.startswith("@")],
        "filled": [k for k, v in node.items() if v is not None and v != ""],
        "name": text("name"), "headline": text("headline"), "description": text("description"),
        "questions": [str(q) for q in questions if q],
        "phones": [p for holder in (node, *contacts) for p in strings(holder.get("telephone"))],
        "emails": [e.removeprefix("mailto:") for e in strings(node.get("email"))],
        "same_as": [s for s in strings(node.get("sameAs")) if s.startswith(("http://", "https://"))],
        "areas": [area_name(a) for a in listed(node.get("areaServed"))],
        "hours": hours_of(node), "address": address_of(node),
    }


def top_types(value) -> list[str]:
    """Types of a block's own nodes, of its items and of its @graph, not of what they hold."""
    nodes = [x for item in listed(value) for x in ([item, *listed(item.get("@graph"))] if isinstance(item, dict) else [])]
    return [str(t) for n in nodes if isinstance(n, dict) for t in listed(n.get("@type"))]


def repaired(block: str, known: set[str], renames: dict[str, str]) -> str | None:
    """A block without unknown types (Organization where none is left) and with wrong properties renamed; null if it is no JSON."""
    found, _ = parsed([block])
    for node in (v for v in values_of(found[0]) if isinstance(v, dict)) if found else ():
        if node.get("@type"):
            types = [str(t) for t in listed(node["@type"])]
            kept = [t for t in types if t.rsplit("schema.org/", 1)[-1] in known]
            if len(kept) != len(types):
                node["@type"] = kept if len(kept) > 1 else kept[0] if kept else "Organization"
            for wrong, right in renames.items():
                if wrong in node and right not in node:
                    node[right] = node.pop(wrong)
    return json.dumps(found[0], ensure_ascii=False) if found else None


def json_ld_facts(blocks: list[str]) -> dict:
    found, broken = parsed(blocks)
    every = [v for b in found for v in values_of(b)]
    return {
        "json_ld_broken": broken,
        "json_ld_types": list(dict.fromkeys(t for b in found for t in top_types(b))),
        "nodes": [described(v) for v in every if isinstance(v, dict) and v.get("@type")],
        "json_strings": [v for v in every if isinstance(v, str)],
    }
