"""Facts of one HTML page in one pass over its tags. A small helper of ``operators.extraction``."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from sitegauge.functions.json_ld import json_ld_facts
from sitegauge.functions.urls import origin, resolve

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose start ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
ENDS_SAME = {"li", "option", "tr", "td", "th", "dt", "dd"}
#: Style declarations that conceal an element.
HIDDEN_STYLE = re.compile(
    r"(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:\.0+)?(?:px|pt|em|rem)?\s*(?:;|!|$)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|!|$)"
    r"|(?:left|top|text-indent|margin-left)\s*:\s*-\d{3,}(?:px)?|clip\s*:\s*rect\(\s*0)",
    re.I,
)
#: Scripts that send visitors elsewhere, and the target of a refresh.
SCRIPT_TARGET = re.compile(r"(?:window\.|document\.|top\.)?location(?:\.href)?\s*(?:=|\.replace\(|\.assign\()\s*['\"`](https?://[^'\"`]+)['\"`]", re.I)
REFRESH_TARGET = re.compile(r"url\s*=\s*['\"]?([^'\";\s]+)", re.I)
#: Links that are kept of a concealed element.
HIDDEN_LINKS = 25
#: Elements that may stand before the body, which any other one and any text begin where no tag does.
BEFORE_BODY = {"html", "head", "body", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
DOCUMENT = {"html", "head", "body"}
DROPPED = {"script", "style", "noscript", "template", "svg"}


def collapse(text: str) -> str:
    return " ".join(text.split())


class PageParser(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.stack: list[str] = []
        self.tags: Counter = Counter()
        self.ids: Counter = Counter()
        self.metas: dict[str, str] = {}
        self.title: str | None = None
        self.open: list[tuple[str, int, list[str], dict]] = []  # elements whose text is wanted
        self.headings, self.links, self.images, self.iframes, self.scripts, self.sheets = [], [], [], [], [], []
        self.json_ld, self.comments, self.hidden, self.hreflang, self.rels = [], [], [], [], Counter()
        self.body, self.visible, self.labels, self.redirects, self.tels, self.mails = [], [], [], [], [], []
        self.meta_counts: Counter = Counter()
        self.depth = self.style_bytes = self.items = 0
        self.canonical = self.charset = self.lang = self.icon = None
        self.doctype = False

    def handle_decl(self, decl):
        self.doctype |= decl.lower().startswith("doctype")

    def handle_comment(self, data):
        self.comments.append(data)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag not in BEFORE_BODY:
            self.enter_body()
        elif tag in DOCUMENT and "body" in self.stack:  # a second one begins nothing
            self.lang = self.lang or (tag == "html" and a.get("lang")) or None
            return
        if tag in ENDS_P and "p" in self.stack:
            self.close("p")
        if tag in ENDS_SAME and self.stack and self.stack[-1] == tag:
            self.close(tag)
        self.tags[tag] += 1
        self.depth = max(self.depth, len(self.stack) + 1)
        if a.get("id"):
            self.ids[a["id"]] += 1
        self.items += "itemscope" in a
        if "style" in a:
            self.style_bytes += len(a["style"].encode())
        self.labels += [a[k] for k in ("alt", "title", "aria-label") if a.get(k)]
        self.note(tag, a)
        if tag not in VOID:
            self.stack.append(tag)

    def enter_body(self) -> None:
        if "body" not in self.stack:
            if "head" in self.stack:
                self.close("head")
            self.stack.append("body")

    def redirect(self, where: str, target: str | None) -> None:
        if target and origin(target) and origin(target) != origin(self.base):
            self.redirects.append({"where": where, "target": target})

    def note(self, tag, a):
        in_body = "body" in self.stack
        reason = "hidden attribute" if "hidden" in a else "inline style" if HIDDEN_STYLE.search(a.get("style", "")) else None
        if in_body and reason and tag not in VOID and not any(kind == "hidden" for kind, *_ in self.open):
            self.want("hidden", {"reason": reason, "tag": tag, "links": []})
        if tag == "html":
            self.lang = self.lang or a.get("lang") or None
        elif tag == "meta":
            key = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()
            if key:
                self.metas.setdefault(key, a.get("content", ""))
                self.meta_counts[key] += 1
            if a.get("http-equiv", "").lower() == "refresh" and (m := REFRESH_TARGET.search(a.get("content", ""))):
                self.redirect("meta refresh", resolve(m[1], self.base))
            self.charset = self.charset or a.get("charset")
        elif tag == "link":
            rel = a.get("rel", "").lower()
            self.rels[rel] += 1
            if rel == "canonical":
                self.canonical = self.canonical or resolve(a.get("href"), self.base)
            elif rel == "stylesheet":
                media = a.get("media")
                self.sheets.append({"href": a.get("href"), "media": media, "blocking": media in (None, "", "all", "screen")})
            elif rel == "alternate" and "hreflang" in a:
                self.hreflang.append({"lang": a["hreflang"], "href": a.get("href")})
            elif rel in ("icon", "shortcut icon"):
                self.icon = self.icon or a.get("href")
        elif tag == "title" and self.title is None:
            self.want("title", {})
        elif re.fullmatch("h[1-6]", tag):
            self.want("heading", {"level": int(tag[1])})
        elif tag == "a" and a.get("href"):
            href = a["href"].strip()
            if m := re.match("(tel|mailto):([^?]+)", href, re.I):
                (self.tels if m[1].lower() == "tel" else self.mails).append(m[2])
            if not re.match("(?:javascript:|mailto:|tel:)", href, re.I):
                there = resolve(href, self.base)
                self.want("link", {
                    "href": href, "resolved": there, "rel": a.get("rel", "").lower(), "target": a.get("target", "").lower(), "title": a.get("title"),
                    "internal": there is not None and origin(there) == origin(self.base), "is_anchor": href.startswith("#"),
                    "protocol_relative": href.startswith("//"), "has_image": False,
                })
        elif tag == "img":
            for kind, _, _, d in self.open:
                if kind == "link":
                    d["has_image"] = True
            style = a.get("style", "")
            self.images.append({
                "src": a.get("src") or a.get("data-src"), "alt": a.get("alt"), "width": a.get("width"), "height": a.get("height"),
                "loading": a.get("loading", "").lower(), "priority": a.get("fetchpriority", "").lower(), "srcset": a.get("srcset"),
                "style_dims": "width" in style and "height" in style, "in_picture": "picture" in self.stack,
            })
        elif tag == "iframe":
            self.iframes.append({"src": a.get("src"), "has_dims": bool(a.get("width")) and bool(a.get("height"))})
        elif tag == "script":
            kind, src = a.get("type", "").lower(), a.get("src") or None
            in_head = "head" in self.stack
            self.want("script", {
                "src": src, "type": kind, "in_head": in_head,
                "blocking": bool(src) and in_head and not a.get("async") and not a.get("defer") and kind != "module", "inline_bytes": 0,
            })
        elif tag == "style":
            self.want("style", {})

    def want(self, kind, d):
        self.open.append((kind, len(self.stack), [], d))

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        if tag in ("html", "body"):  # neither ends the body: what follows, white space too, stands in it
            self.enter_body()
        else:
            self.close(tag)

    def close(self, tag):
        while self.stack:
            last = self.stack.pop()
            while self.open and self.open[-1][1] >= len(self.stack):
                self.finish(*self.open.pop())
            if last == tag:
                break

    def finish(self, kind, _, parts, d):
        text = "".join(parts)
        if kind == "title":
            self.title = text.strip()
        elif kind == "heading":
            self.headings.append(d | {"text": collapse(text)})
        elif kind == "link":
            self.links.append(d | {"text": collapse(text)})
            for outer, _, _, hidden in self.open:
                if outer == "hidden" and d["resolved"] and len(hidden["links"]) < HIDDEN_LINKS:
                    hidden["links"].append({"href": d["resolved"], "text": collapse(text)[:80]})
        elif kind == "hidden":
            self.hidden.append(d | {"text": collapse(text)[:500]})
        elif kind == "style":
            self.style_bytes += len(text.encode())
        else:
            if d["type"] == "application/ld+json":
                self.json_ld.append(text)
            elif not d["src"]:
                for target in SCRIPT_TARGET.findall(text):
                    self.redirect("inline script", target)
            self.scripts.append(d | {"inline_bytes": 0 if d["src"] else len(text.encode())})

    def handle_data(self, data):
        for _, _, parts, _ in self.open:
            parts.append(data)
        if data.strip() and not {"title", *DROPPED}.intersection(self.stack):
            self.enter_body()
        if "body" in self.stack:
            self.body.append(data)
            if not DROPPED.intersection(self.stack):
                self.visible.append(data)

    def facts(self, html: str) -> dict:
        self.feed(re.sub(r"</?[A-Za-z][^>]*\Z", "", html))  # a tag that the page ends in is none
        super().close()
        while self.stack:
            self.close(self.stack[-1])
        while self.open:
            self.finish(*self.open.pop())
        text = collapse("".join(self.body))
        charset = self.charset or (m[1] if (m := re.search(r"charset=([\w-]+)", self.metas.get("content-type", ""), re.I)) else None)
        return {
            "title": self.title or "", "metas": self.metas, "canonical": self.canonical, "headings": self.headings, "links": self.links,
            "images": self.images, "iframes": self.iframes, "scripts": self.scripts, "stylesheets": self.sheets, "inline_style_bytes": self.style_bytes,
            "json_ld": self.json_ld, "tags": dict(self.tags), "node_count": sum(self.tags.values()), "max_depth": self.depth, "microdata": self.items,
            "duplicate_ids": [{"id": k, "count": n} for k, n in self.ids.items() if n > 1], "text": text, "visible_text": collapse("".join(self.visible)),
            "has_doctype": html.lstrip().lower().startswith("<!doctype"), "charset": charset, "lang": self.lang,
            "has_favicon": any(self.rels[r] for r in ("icon", "shortcut icon", "apple-touch-icon")), "favicon": self.icon, "hreflang": self.hreflang,
            "comments": self.comments, "hidden": self.hidden, "html_bytes": len(html.encode()), "labels": self.labels, "redirects": self.redirects,
            "meta_counts": dict(self.meta_counts), "tels": self.tels, "mails": self.mails,
        } | json_ld_facts(self.json_ld)


def page_facts(html: str | None, url: str | None) -> dict:
    """Facts of a page; null HTML counts as empty."""
    return PageParser(url or "").facts(html or "")
