"""SQL that gives the rows of the audit queries on the driver's tables, for comparison."""

from __future__ import annotations

from sitegauge.operators import risk

STOP = ", ".join(f"'{w}'" for w in risk.STOP_WORDS)
FACTS = r"""
raw AS (
  SELECT page_id, url, html, regexp_extract(url, '://([^/?#]*)', 1) AS site,
    trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')) AS title,
    regexp_extract(html, '(?s)<body>(.*)$', 1) AS body FROM pages),
pf AS (
  SELECT page_id, url, html, site, title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, starts_with(lower(ltrim(html)), '<!doctype') AS has_doctype,
    len(regexp_extract_all(html, '<h1>')) AS h1, len(regexp_extract_all(html, '<a href=')) AS links, strlen(html) AS html_bytes,
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM raw),
f AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words,
    CAST(floor(100 * length(text) / length(html) + 0.5) AS BIGINT) AS ratio FROM pf)"""
CHECKS = (
    FACTS
    + """,
c AS (SELECT page_id, site, unnest([
  {'m': 'meta_and_social', 'k': 'title.present', 'o': CASE WHEN title = '' THEN 'critical' ELSE 'pass' END},
  {'m': 'meta_and_social', 'k': 'title.length', 'o': CASE WHEN title = '' THEN 'absent' WHEN length(title) < 15 THEN 'critical' WHEN length(title) < 50 THEN 'warning'
     WHEN length(title) <= 60 AND floor(length(title) * 8.5 + 0.5) <= 580 THEN 'pass' WHEN length(title) <= 70 AND floor(length(title) * 8.5 + 0.5) <= 600 THEN 'warning' ELSE 'critical' END},
  {'m': 'meta_and_social', 'k': 'h1.present', 'o': CASE WHEN h1 = 0 THEN 'critical' WHEN h1 > 1 THEN 'warning' ELSE 'pass' END},
  {'m': 'meta_and_social', 'k': 'html.lang', 'o': CASE WHEN lang = '' THEN 'notice' ELSE 'pass' END},
  {'m': 'meta_and_social', 'k': 'charset.present', 'o': CASE WHEN charset = '' THEN 'notice' ELSE 'pass' END},
  {'m': 'meta_and_social', 'k': 'viewport.present', 'o': CASE WHEN contains(html, 'name="viewport"') THEN 'pass' ELSE 'warning' END},
  {'m': 'meta_and_social', 'k': 'canonical.present', 'o': CASE WHEN contains(html, 'rel="canonical"') THEN 'pass' ELSE 'warning' END},
  {'m': 'link_navigation', 'k': 'links.internal', 'o': CASE WHEN links < 3 THEN 'warning' WHEN links < 5 THEN 'notice' ELSE 'pass' END},
  {'m': 'dom_headings', 'k': 'headings.h1', 'o': CASE WHEN h1 = 0 THEN 'critical' WHEN h1 > 1 THEN 'warning' ELSE 'pass' END},
  {'m': 'dom_headings', 'k': 'dom.text_html_ratio', 'o': CASE WHEN ratio < 5 THEN 'warning' WHEN ratio < 10 THEN 'notice' ELSE 'pass' END},
  {'m': 'dom_headings', 'k': 'dom.word_count', 'o': CASE WHEN words < 200 THEN 'warning' WHEN words < 300 THEN 'notice' ELSE 'pass' END},
  {'m': 'eeat_trust', 'k': 'eeat.https', 'o': CASE WHEN starts_with(lower(url), 'https:') THEN 'pass' ELSE 'critical' END},
  {'m': 'eeat_trust', 'k': 'eeat.thin_content', 'o': CASE WHEN words < 200 THEN 'warning' WHEN words < 300 THEN 'notice' ELSE 'pass' END}]) AS r FROM f),
checks AS (SELECT page_id, site, r.m AS module, r.k AS check_id, CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN 'fail' ELSE r.o END AS status,
  CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN r.o ELSE 'info' END AS severity FROM c WHERE r.o <> 'absent'),
weighted AS (SELECT *, CASE severity WHEN 'critical' THEN 6 WHEN 'warning' THEN 3 ELSE 1 END AS w,
  CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END AS sr FROM checks)"""
)
#: Checks beyond those of CHECKS, on pages that have no images, metas but their charset, frames, or structured data.
ALL_CHECKS = (
    CHECKS
    + r""",
parts AS (SELECT *, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchors FROM f),
trusted AS (SELECT *, CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)/(about|about-us|company|team)(/|$|\?)'))) > 0 AS INT)
    + CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)/(contact|contact-us|support|help)(/|$|\?)'))) > 0 AS INT)
    + CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)/(privacy|privacy-policy|legal)(/|$|\?)'))) > 0 AS INT)
    + CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)/(terms|terms-of-service|tos|tos-of-service|legal/terms)(/|$|\?)'))) > 0 AS INT) AS trust FROM parts),
more AS (SELECT page_id, unnest([
  {'m': 'meta_and_social', 'k': 'headings.hierarchy', 'o': CASE WHEN h1 = 0 THEN 'warning' ELSE 'pass' END},
  {'m': 'link_navigation', 'k': 'links.anchor_text', 'o': CASE WHEN len(list_filter(anchors, lambda x: regexp_full_match(x, '(?i)(click here|here|read more|learn more|more|this|link|website|http\S*)'))) > 0
     THEN 'warning' ELSE 'pass' END},
  {'m': 'eeat_trust', 'k': 'eeat.author', 'o': CASE WHEN regexp_matches(text[1:2000], '(?i)(^|[^\p{L}\p{N}_])(by|author|written by|reviewed by)([^\p{L}\p{N}_]|$)') THEN 'notice' ELSE 'warning' END},
  {'m': 'eeat_trust', 'k': 'eeat.trust_links', 'o': CASE WHEN trust = 0 THEN 'critical' WHEN trust < 3 THEN 'warning' ELSE 'pass' END},
  {'m': 'eeat_trust', 'k': 'eeat.contact_info', 'o': CASE WHEN regexp_matches(text, '(?i)\b(\+?\d[\d\s().-]{7,}|@[a-z0-9.-]+\.[a-z]{2,})\b') THEN 'pass' ELSE 'skip' END},
  {'m': 'performance_cwv', 'k': 'cwv.lcp_candidate', 'o': CASE WHEN h1 = 0 THEN 'notice' ELSE 'pass' END}]) AS r FROM trusted
  UNION ALL SELECT page_id, {'m': m, 'k': k, 'o': o} FROM f, (VALUES ('meta_and_social', 'meta_description.present', 'critical'), ('meta_and_social', 'robots.noindex', 'pass'),
    ('meta_and_social', 'og.complete', 'warning'), ('meta_and_social', 'og.image_dims', 'skip'), ('meta_and_social', 'twitter.card', 'notice'), ('meta_and_social', 'favicon.present', 'notice'),
    ('meta_and_social', 'images.alt', 'skip'), ('dom_headings', 'dom.node_count', 'pass'), ('dom_headings', 'dom.depth', 'pass'), ('dom_headings', 'dom.landmarks', 'warning'),
    ('dom_headings', 'dom.main', 'warning'), ('dom_headings', 'dom.semantic_rich', 'notice'), ('dom_headings', 'dom.duplicate_ids', 'pass'), ('dom_headings', 'dom.iframe_dims', 'skip'),
    ('link_navigation', 'links.inventory', 'pass'), ('link_navigation', 'links.naked_urls', 'pass'), ('link_navigation', 'links.noopener', 'pass'), ('link_navigation', 'links.rel', 'pass'),
    ('link_navigation', 'links.hreflang', 'skip'), ('schema_rich', 'schema.syntax', 'skip'), ('schema_rich', 'schema.present', 'warning'), ('eeat_trust', 'eeat.published_time', 'notice'),
    ('eeat_trust', 'eeat.modified_time', 'notice'), ('performance_cwv', 'cwv.lcp_fetchpriority', 'skip'), ('performance_cwv', 'cwv.lcp_lazy', 'skip'), ('performance_cwv', 'cwv.image_dims', 'skip'),
    ('performance_cwv', 'cwv.iframe_dims', 'skip'), ('performance_cwv', 'cwv.blocking_scripts', 'pass'), ('performance_cwv', 'cwv.blocking_css', 'pass'),
    ('performance_cwv', 'cwv.image_formats', 'skip'), ('performance_cwv', 'cwv.inline_payload', 'pass')) v(m, k, o)),
every AS (SELECT page_id, module, check_id, status, severity FROM checks UNION ALL
  SELECT page_id, r.m, r.k, CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN 'fail' ELSE r.o END, CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN r.o ELSE 'info' END FROM more),
every_w AS (SELECT *, CASE severity WHEN 'critical' THEN 6 WHEN 'warning' THEN 3 ELSE 1 END AS w FROM every),
every_s AS (SELECT page_id, module, coalesce(CAST(floor(100.0 * sum(CASE WHEN status = 'pass' THEN w ELSE 0 END) / sum(w) FILTER (status <> 'skip') + 0.5) AS BIGINT), 100) AS score FROM every_w GROUP BY ALL)"""
)
#: What failed checks are told as (an open list), and the order of findings.
RULES = """rules(check_id, finding, impact, effort, area, n) AS (VALUES ('schema.present', 'schema.missing', 'high', 'small', 'schema', 4), ('title.present', 'meta.title_missing', 'high', 'small', 'meta', 8),
  ('title.length', 'meta.title_length', 'low', 'small', 'meta', 9), ('meta_description.present', 'meta.description_missing', 'medium', 'small', 'meta', 10),
  ('h1.present', 'meta.h1', 'low', 'small', 'meta', 12), ('headings.h1', 'meta.h1', 'low', 'small', 'meta', 12), ('canonical.present', 'meta.canonical', 'low', 'small', 'meta', 13),
  ('eeat.thin_content', 'content.thin', 'medium', 'large', 'content', 15), ('viewport.present', 'engine.viewport.present', 'high', 'small', 'meta', 16),
  ('og.complete', 'engine.og.complete', 'low', 'small', 'meta', 16), ('eeat.https', 'engine.eeat.https', 'high', 'small', 'access', 16),
  ('links.internal', 'engine.links.internal', 'low', 'medium', 'content', 16), ('headings.hierarchy', 'engine.headings.hierarchy', 'low', 'small', 'meta', 16),
  ('eeat.trust_links', 'engine.eeat.trust_links', NULL, 'medium', 'other', 16), ('eeat.author', 'engine.eeat.author', NULL, 'medium', 'other', 16),
  ('links.anchor_text', 'engine.links.anchor_text', NULL, 'medium', 'other', 16), ('dom.landmarks', 'engine.dom.landmarks', NULL, 'medium', 'other', 16), ('dom.main', 'engine.dom.main', NULL, 'medium', 'other', 16),
  ('dom.text_html_ratio', 'engine.dom.text_html_ratio', NULL, 'medium', 'other', 16), ('dom.word_count', 'engine.dom.word_count', NULL, 'medium', 'other', 16)"""
RANKED = """SELECT page_id, finding, impact, effort, area, row_number() OVER (PARTITION BY page_id ORDER BY
  CASE impact WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, list_position(['access', 'render', 'facts', 'schema', 'llms', 'meta', 'content', 'other'], area), n, finding) AS rank
FROM found"""
GRADE = "CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 70 THEN 'Good' WHEN overall >= 50 THEN 'Needs Attention' ELSE 'Critical' END AS grade"
WEIGHTS = """(VALUES ('meta_and_social', 12), ('geo_ai_validator', 12), ('js_render_diff', 14), ('dom_headings', 8), ('link_navigation', 10), ('schema_rich', 10), ('eeat_trust', 10),
  ('server_security', 10), ('performance_cwv', 12)) v(module, mw)"""
HITS = """
hits AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS impressions, sum(CAST(value AS DECIMAL(18, 6))) AS wp
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "page_facts": f"WITH {FACTS} SELECT page_id, title, lang, charset, has_doctype, h1, links, words, length(text) AS text_chars, html_bytes FROM f",
    "core_checks": f"WITH {CHECKS} SELECT page_id, module, check_id, status, severity FROM checks",
    "core_counts": f"""WITH {CHECKS} SELECT page_id, count(*) FILTER (status = 'fail' AND severity = 'critical') AS critical,
      count(*) FILTER (status = 'fail' AND severity = 'warning') AS warnings, count(*) FILTER (status = 'fail' AND severity = 'notice') AS notices,
      count(*) FILTER (status = 'pass') AS passes FROM checks GROUP BY page_id""",
    "core_scores": f"""WITH {CHECKS},
      s AS (SELECT page_id, module, floor(100.0 * sum(CASE WHEN status = 'pass' THEN w ELSE 0 END) / sum(w) + 0.5) AS score FROM weighted GROUP BY ALL),
      o AS (SELECT page_id, CAST(floor(sum(score * mw) / sum(mw) + 0.5) AS BIGINT) AS overall FROM s JOIN (VALUES ('meta_and_social', 12), ('dom_headings', 8),
        ('link_navigation', 10), ('eeat_trust', 10)) v(module, mw) USING (module) GROUP BY page_id)
      SELECT page_id, overall, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 70 THEN 'Good' WHEN overall >= 50 THEN 'Needs Attention' ELSE 'Critical' END AS grade FROM o""",
    "core_recommendations": f"""WITH {CHECKS} SELECT page_id, module, check_id, severity, w AS impact,
      row_number() OVER (PARTITION BY page_id ORDER BY w DESC, check_id, module) AS rank FROM weighted WHERE status = 'fail'""",
    "core_findings": f"""WITH {CHECKS},
      rules(check_id, finding, impact, effort, area, n) AS (VALUES ('title.present', 'meta.title_missing', 'high', 'small', 'meta', 1), ('title.length', 'meta.title_length', 'low', 'small', 'meta', 2),
        ('h1.present', 'meta.h1', 'low', 'small', 'meta', 3), ('headings.h1', 'meta.h1', 'low', 'small', 'meta', 3), ('canonical.present', 'meta.canonical', 'low', 'small', 'meta', 4),
        ('eeat.thin_content', 'content.thin', 'medium', 'large', 'content', 5), ('viewport.present', 'engine.viewport.present', 'high', 'small', 'meta', 6),
        ('eeat.https', 'engine.eeat.https', 'high', 'small', 'access', 6), ('links.internal', 'engine.links.internal', 'low', 'medium', 'content', 6),
        ('dom.text_html_ratio', 'engine.dom.text_html_ratio', 'low', 'medium', 'other', 6), ('dom.word_count', 'engine.dom.word_count', 'low', 'medium', 'other', 6)),
      found AS (SELECT DISTINCT page_id, finding, impact, effort, area, n FROM checks JOIN rules USING (check_id)
        WHERE status = 'fail' AND (n < 6 OR severity IN ('critical', 'warning')))
      SELECT page_id, finding, impact, effort, area, row_number() OVER (PARTITION BY page_id ORDER BY
        CASE impact WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, list_position(['access', 'render', 'facts', 'schema', 'llms', 'meta', 'content', 'other'], area), n, finding) AS rank
      FROM found""",
    "core_snippets": f"""WITH {CHECKS} SELECT DISTINCT page_id, CASE check_id WHEN 'canonical.present' THEN 'canonical' ELSE 'title' END AS snippet FROM checks
      WHERE status = 'fail' AND check_id IN ('title.present', 'title.length', 'canonical.present')""",
    "duplicate_titles": f"WITH {FACTS} SELECT site, lower(trim(title)) AS value, count(*) AS pages FROM f GROUP BY ALL HAVING value <> '' AND pages > 1",
    "thin_pages": f"WITH {FACTS} SELECT site, url, words FROM f WHERE words < 150",
    "gap_report": f"""WITH {CHECKS},
      you AS (SELECT site FROM raw GROUP BY site ORDER BY count(*) DESC, site LIMIT 1),
      sites AS (SELECT site, module, check_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'skip' END AS status,
        max(sr) FILTER (status = 'fail') AS sr FROM weighted GROUP BY ALL),
      mine AS (SELECT * FROM sites WHERE site = (FROM you) AND status <> 'skip'),
      theirs AS (SELECT module, check_id, count(*) FILTER (status = 'pass') AS passing, count(*) FILTER (status = 'fail') AS failing, max(sr) AS their
        FROM sites WHERE site <> (FROM you) AND status <> 'skip' GROUP BY ALL),
      b AS (SELECT module, check_id, status, passing, failing, greatest(coalesce(sr, -1), coalesce(their, -1)) AS top FROM mine JOIN theirs USING (module, check_id)),
      r AS (SELECT *, CASE WHEN status = 'fail' AND passing > 0 THEN 'gap' WHEN status = 'fail' THEN 'open_ground' WHEN status = 'pass' AND failing > 0 THEN 'edge' END AS kind,
        CASE top WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 0 THEN 'info' ELSE 'notice' END AS severity FROM b),
      x AS (SELECT kind, module, check_id, severity, passing, failing, top,
        CASE top WHEN 3 THEN 6 WHEN 2 THEN 3 ELSE 1 END * CASE kind WHEN 'gap' THEN passing WHEN 'edge' THEN failing ELSE 1 END AS weight FROM r WHERE kind IS NOT NULL)
      SELECT kind, module, check_id, severity, passing, failing, weight,
        row_number() OVER (PARTITION BY kind ORDER BY weight DESC, top DESC, module, check_id) AS rank FROM x""",
    "page_checks": f"WITH {ALL_CHECKS} SELECT * FROM every",
    "module_scores": f"WITH {ALL_CHECKS} SELECT * FROM every_s",
    "overall_scores": f"""WITH {ALL_CHECKS}, o AS (SELECT page_id, CAST(floor(sum(score * mw) / sum(mw) + 0.5) AS BIGINT) AS overall FROM every_s JOIN {WEIGHTS} USING (module) GROUP BY page_id)
      SELECT page_id, overall, {GRADE} FROM o""",
    "recommendations": f"""WITH {ALL_CHECKS} SELECT page_id, module, check_id, severity, w AS impact, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, check_id, module) AS rank
      FROM every_w WHERE status = 'fail' QUALIFY rank <= 5""",
    "findings": f"""WITH {ALL_CHECKS},
      {RULES}),
      found AS (SELECT DISTINCT page_id, finding, coalesce(impact, CASE severity WHEN 'critical' THEN 'medium' ELSE 'low' END) AS impact, effort, area, n FROM every JOIN rules USING (check_id)
        WHERE status = 'fail' AND (n < 16 OR severity IN ('critical', 'warning')))
      {RANKED}""",
    "page_flags": f"""WITH {FACTS},
      w AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP}))) AS w FROM f)
      SELECT DISTINCT page_id, 'risk.title_stuffing' AS flag, 'notice' AS severity, 1::BIGINT AS rank FROM w GROUP BY page_id, w HAVING count(*) >= 3""",
    "rate_limits": """WITH RECURSIVE h AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
      r AS (SELECT user_id, "at", n, TRUE AS accepted, 0::BIGINT AS wait, ["at"] AS live FROM h WHERE n = 1
        UNION ALL SELECT h.user_id, h."at", h.n, len(l) < 2, CASE WHEN len(l) < 2 THEN 0 ELSE greatest(1, list_min(l) + 86400 - h."at") END, CASE WHEN len(l) < 2 THEN list_append(l, h."at") ELSE l END
        FROM (SELECT r.user_id, r.n, h."at", list_filter(r.live, lambda x: x > h."at" - 86400) AS l FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1) p
        JOIN h ON h.user_id = p.user_id AND h.n = p.n + 1)
      SELECT user_id, "at", accepted, wait FROM r""",
    "search_totals": f"""WITH {HITS} SELECT CAST(sum(clicks) FILTER (day BETWEEN DATE '2024-01-18' AND DATE '2024-01-27') AS BIGINT) AS clicks,
      CAST(sum(impressions) FILTER (day BETWEEN DATE '2024-01-18' AND DATE '2024-01-27') AS BIGINT) AS impressions,
      CAST(sum(clicks) FILTER (day BETWEEN DATE '2024-01-08' AND DATE '2024-01-17') AS BIGINT) AS previous_clicks FROM hits""",
    "top_terms": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9À-ɏ]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})) AS w FROM documents),
      e AS (SELECT doc_id, len(w) AS words, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w),
      c AS (SELECT doc_id, term, count(*) AS times, min(pos) AS pos, max(words) AS words FROM e GROUP BY ALL)
      SELECT doc_id, words, term, times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, pos) = 1""",
    "text_summaries": r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)
      SELECT doc_id, CASE WHEN length(c) > 60 THEN c[1:59] || '…' ELSE c END AS summary,
        CASE WHEN strlen(text) < 1024 THEN printf('%d B', strlen(text)) WHEN strlen(text) < 1048576 THEN printf('%.1f KB', floor(strlen(text) / 1024 * 10 + 0.5) / 10)
          ELSE printf('%.2f MB', floor(strlen(text) / 1048576 * 100 + 0.5) / 100) END AS size FROM t""",
    "turn_similarity": """WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
      s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9À-ɏ]+'), lambda x: length(x) >= 3)) AS x,
        list_distinct(list_filter(regexp_split_to_array(lower(b), '[^a-z0-9À-ɏ]+'), lambda x: length(x) >= 3)) AS y FROM t WHERE b IS NOT NULL)
      SELECT conv_id, turn, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS similarity FROM s""",
    "ai_addresses": "SELECT conv_id, turn, length(t) >= 8 AND ("
    + " OR ".join("regexp_matches(t, '{}')".format(p.replace("'", "''")) for p in risk.AI_ADDRESSES)
    + r") AS addresses_ai FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)",
    "robots_rules": """WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages)
      SELECT site, group_no, agent, type, path FROM s, (VALUES (0, '*', 'disallow', '/drafts'), (1, '*', 'disallow', '/*?utm_'), (1, '*', 'allow', '/en/'),
        (1, '*', 'disallow', '/en/1*'), (1, '*', 'disallow', '/de/'), (1, '*', 'disallow', '/*.html$'), (2, 'gptbot', 'disallow', '/'), (2, 'ccbot', 'disallow', '/'),
        (3, 'claudebot', 'disallow', '/*'), (3, 'claudebot', 'allow', '/')) v(group_no, agent, type, path)""",
    "crawler_access": """SELECT site, bot, bot IN ('GPTBot', 'CCBot') AS blocked FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages),
      (SELECT unnest(['OAI-SearchBot', 'ChatGPT-User', 'PerplexityBot', 'Claude-SearchBot', 'GPTBot', 'ClaudeBot', 'CCBot', 'anthropic-ai', 'Bytespider', 'Google-Extended',
        'Applebot-Extended']) AS bot)""",
    "urls_allowed": r"""WITH u AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site, url, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages),
      r(pattern, n, allow) AS (VALUES ('^/drafts', 7, 0), ('^/.*\?utm_', 7, 0), ('^/en/', 4, 1), ('^/en/1.*', 6, 0), ('^/de/', 4, 0), ('^/.*\.html$', 8, 0))
      SELECT site, url, coalesce((SELECT max(n * 2 + allow) FROM r WHERE regexp_matches(path, pattern)), 1) % 2 = 1 AS allowed FROM u""",
    "search_performance": f"""WITH {HITS},
      n AS (SELECT key, sum(clicks) AS clicks, sum(impressions) AS impressions, CAST(sum(wp) AS DOUBLE) / sum(impressions) AS p FROM hits WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-27' GROUP BY key),
      b AS (SELECT key, sum(clicks) AS c, CAST(sum(wp) AS DOUBLE) / sum(impressions) AS p FROM hits WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-17' GROUP BY key)
      SELECT n.key, CAST(n.clicks AS BIGINT) AS clicks, CAST(n.impressions AS BIGINT) AS impressions, round(CAST(n.clicks AS DOUBLE) / n.impressions, 6) AS ctr, round(n.p, 4) AS position, CAST(n.clicks - b.c AS BIGINT) AS clicks_change, floor(round(n.p - b.p, 6) * 10 + 0.5) / 10 AS position_change, b.key IS NULL AS new
      FROM n LEFT JOIN b USING (key)""",
    "rank_changes": f"""WITH {HITS},
      n AS (SELECT key, CAST(floor(CAST(sum(wp) AS DOUBLE) / sum(impressions)) AS BIGINT) AS p FROM hits WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-27' GROUP BY key),
      b AS (SELECT key, CAST(floor(CAST(sum(wp) AS DOUBLE) / sum(impressions)) AS BIGINT) AS q FROM hits WHERE day BETWEEN DATE '2024-01-20' AND DATE '2024-01-23' GROUP BY key),
      j AS (SELECT key, p AS position, q AS previous_position, CASE WHEN q IS NULL THEN 'new' WHEN p IS NULL THEN 'lost' WHEN p - q <= -3 THEN 'up' WHEN p - q >= 3 THEN 'down' END AS change
        FROM n FULL JOIN b USING (key))
      SELECT key, CASE WHEN change IN ('new', 'up') THEN 'good' ELSE 'warn' END AS level, change, position, previous_position FROM j WHERE change IS NOT NULL""",
    "active_changes": """WITH n AS (SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-26' AND DATE '2024-01-27'),
      b AS (SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-25')
      SELECT *, 'good' AS level, 'new' AS change FROM (FROM n EXCEPT FROM b) UNION ALL SELECT *, 'warn', 'gone' FROM (FROM b EXCEPT FROM n)""",
    "score_moves": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(round(avg(value)) AS BIGINT) AS avg_score FROM events GROUP BY ALL),
      l AS (SELECT *, lag(avg_score) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM d)
      SELECT event_type, CAST(day AS VARCHAR) AS day, avg_score, previous, CASE WHEN avg_score > previous THEN 'good' ELSE 'warn' END AS level FROM l WHERE abs(avg_score - previous) >= 5""",
    "latest_events": "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY ALL",
    "local_results": """WITH r AS (SELECT s_nationkey AS query, CAST(floor(abs(s_acctbal) % 40) AS BIGINT) AS reviews, s_suppkey % 3 > 0 AS site, s_suppkey % 7 = 0 AS you,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
      SELECT query, min(n) FILTER (you) AS position, count(*) AS total, coalesce(median(reviews) FILTER (NOT you), 0) AS review_median,
        count(*) FILTER (NOT you AND reviews < 5) AS under_5_reviews, count(*) FILTER (NOT site) AS without_website FROM r GROUP BY query""",
}
ORACLES["keyword_stuffing"] = f"SELECT * FROM ({ORACLES['top_terms']}) WHERE words >= 150 AND times / words > 0.06 AND times >= 15"
