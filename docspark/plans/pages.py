"""Queries of the page and section operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import dedup, pages, profiles, sections
from docspark.operators.shared import materialize, spread
from docspark.plans import config

CHARS = 1500


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str, chars: int = CHARS) -> DataFrame:
    return pages.paginate(spread(_docs(spark, sf).select("doc_id", "text")), chars)


def _quality(spark: SparkSession, sf: str, chars: int = CHARS) -> DataFrame:
    return pages.page_quality(_pages(spark, sf, chars))


def content_hashes(spark, sf):
    d, t = _docs(spark, sf), F.coalesce("text", F.lit(""))
    digest = T.content_hash(t)
    return d.select("doc_id", digest.alias("sha256"), T.content_hash(t, "md5").alias("md5"), T.content_hash(t, "sha1").alias("sha1"), T.composite_fingerprint(digest, F.col("source"), F.length(t)).alias("fingerprint"))


def multipart_etags(spark, sf):
    return _docs(spark, sf).select("doc_id", T.multipart_etag(F.coalesce("text", F.lit("")), 1000).alias("etag"))


def dedup_against_history(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    known = d.where("doc_id % 10 = 3").select("content_hash", F.col("doc_id").alias("document_id"))
    return dedup.dedup_against_history(d.where("doc_id % 10 <> 3"), known)


def dedup_statements(spark, sf):
    return dedup.dedup_statements(spread(_docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), 0.8)


def paginate(spark, sf):
    return _pages(spark, sf).select("doc_id", "page_number", "total_pages", F.md5("text").alias("text_md5"))


def page_snippets(spark, sf):
    return pages.page_snippets(_pages(spark, sf)).select("doc_id", "page_number", "has_text", F.md5("snippet").alias("snippet_md5"))


def page_quality(spark, sf):
    q = _quality(spark, sf)
    return q.select("doc_id", "page_number", F.round("quality_score", 6).alias("quality_score"), "is_readable", F.array_join("issues", ",").alias("issues"), "has_text")


def pick_best_parse(spark, sf):
    p = _pages(spark, sf)
    broken = p.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "[a-z]", "#")).otherwise(F.col("text")))
    return pages.pick_best_parse(broken, p).select("doc_id", "page_number", "parser_used", F.md5("text").alias("text_md5"))


def token_budget_groups(spark, sf):
    return pages.token_budget_groups(_pages(spark, sf), 1000)


def assemble_context(spark, sf):
    return pages.assemble_context(_pages(spark, sf), 5000).select("doc_id", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


def hybrid_merge(spark, sf):
    return pages.hybrid_merge(_quality(spark, sf))


def slice_first_pages(spark, sf):
    return pages.slice_first_pages(_pages(spark, sf)).select("doc_id", F.md5("head").alias("head_md5"))


def billable_pages(spark, sf):
    return pages.billable_pages(_quality(spark, sf))


def keyword_matches(spark, sf):
    return sections.keyword_matches(_quality(spark, sf), config.sections(spark)).where("matches > 0").select("doc_id", "page_number", "section_id", "matches")


def rule_bonus(spark, sf):
    return sections.rule_bonus(_quality(spark, sf), config.rules(spark))


def section_scores(spark, sf):
    return sections.section_scores(_quality(spark, sf), config.sections(spark), config.rules(spark)).select("doc_id", "section_id", "page_number", "score")


def top_pages(spark, sf):
    return sections.top_pages(sections.section_scores(_quality(spark, sf), config.sections(spark), config.rules(spark)))


def _scored(spark, sf, chars=400):
    """Page scores, written once without texts and dealt by document: the texts are read and measured once."""
    return materialize(sections.page_scores(_quality(spark, sf, chars), config.sections(spark), config.rules(spark)).repartition("doc_id"))


def _selected(spark, sf):
    scored = _scored(spark, sf)
    return scored, sections.top_pages(sections.scores_of(scored))


def route_low_quality(spark, sf):
    q, sel = _selected(spark, sf)
    return sections.route_low_quality(sel, q, config.sections(spark))


def cover_uncovered(spark, sf):
    q, sel = _selected(spark, sf)
    return sections.cover_uncovered(sel, q, config.sections(spark))


def dedup_across_sections(spark, sf):
    _, sel = _selected(spark, sf)
    return sections.dedup_across_sections(sel, config.sections(spark))


def expand_neighbours(spark, sf):
    q, sel = _selected(spark, sf)
    return sections.expand_neighbours(sections.dedup_across_sections(sel, config.sections(spark)), q, config.sections(spark))


def page_selection(spark, sf):
    return sections.select_pages(_scored(spark, sf), config.sections(spark))


def _plan(spark, sf):
    scored = _scored(spark, sf)
    return scored, sections.extraction_plan(sections.select_pages(scored, config.sections(spark)), scored, config.sections(spark))


def extraction_plan(spark, sf):
    return _plan(spark, sf)[1].select("doc_id", "section_id", F.array_join(F.transform("section_pages", lambda p: p.cast("string")), ",").alias("section_pages"))


def plan_coverage(spark, sf):
    scored, plan = _plan(spark, sf)
    return sections.plan_coverage(plan, scored).withColumn("share", F.round("share", 6))


def legacy_bonus_profiles(spark, sf):
    return sections.rule_bonus(_quality(spark, sf, 400), profiles.legacy_rules(spark))


def legacy_defaults(spark, sf):
    """Pages with a bonus of at least 3 as the selection."""
    scored = materialize(_quality(spark, sf, 400))
    chosen = sections.rule_bonus(scored, profiles.legacy_rules(spark)).where("bonus >= 3")
    return profiles.legacy_defaults(chosen, scored)


def start_page_ranges(spark, sf):
    q = _pages(spark, sf, 400)
    names = F.array(*(F.lit(x) for x in ("s_en", "s_fr", "s_other", "s_es", "s_de")))
    starts = q.where("(doc_id * 7 + page_number * 3) % 5 = 0").select("doc_id", F.element_at(names, (F.col("page_number") % 5 + 1).cast("int")).alias("section_id"), F.col("page_number").alias("start_page"), "total_pages")
    return sections.start_page_ranges(starts, config.sections(spark))


def classify_by_keywords(spark, sf):
    return sections.classify_by_keywords(spread(_docs(spark, sf)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), config.sections(spark))


def reclassify_if_empty(spark, sf):
    _, sel = _selected(spark, sf)
    return sections.reclassify_if_empty(sel, _docs(spark, sf), ["s_en", "s_de"])


QUERIES = {
    f.__name__: f
    for f in (
        content_hashes, multipart_etags, dedup_against_history, dedup_statements, paginate, page_snippets, page_quality, pick_best_parse, token_budget_groups, assemble_context, hybrid_merge, slice_first_pages, billable_pages,
        keyword_matches, rule_bonus, section_scores, top_pages, route_low_quality, cover_uncovered, dedup_across_sections, expand_neighbours, page_selection, extraction_plan, plan_coverage, legacy_bonus_profiles, legacy_defaults, start_page_ranges, classify_by_keywords, reclassify_if_empty,
    )
}

# The SQL below is written independently of the operators, on the same tables.
DOCS = "docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


def _pages_sql(chars: int) -> str:
    return f"""{DOCS}, pages_ AS (SELECT doc_id, p::INT AS page_number, n::INT AS total_pages, substr(text, ((p - 1) * {chars} + 1)::BIGINT, {chars}) AS text
      FROM (SELECT doc_id, text, greatest(1, ceil(length(text) / {chars}.0))::BIGINT AS n FROM docs) d, LATERAL (SELECT unnest(range(1, n + 1)) AS p) u)"""


def _strip_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def _quality_sql(source: str, name: str) -> str:
    found = " + ".join(f"contains(lower(text), '{w}')::INT" for w in T.COMMON_WORDS)
    return rf"""{name}_m AS (SELECT *, length(text) AS n, len(regexp_extract_all(text, '/\d+\s*/\d+')) / greatest(1.0::DOUBLE, length(text) / 10.0::DOUBLE) AS glyph,
        length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(text)::DOUBLE AS alnum, length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(text)::DOUBLE AS special,
        {found} AS found, length({_strip_sql("text")}) AS stripped FROM {source}),
      {name}_s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - least(1.0::DOUBLE, glyph * 10)) * 0.4::DOUBLE + alnum * 0.3::DOUBLE + least(1.0::DOUBLE, found / 5.0::DOUBLE) * 0.3::DOUBLE)) AS score FROM {name}_m),
      {name} AS (SELECT * EXCLUDE (n, stripped, score), CASE WHEN stripped < 10 THEN 0.0 ELSE score END AS quality_score, stripped >= 10 AND score >= 0.4 AND glyph <= 0.05 AS is_readable,
        CASE WHEN stripped < 10 THEN 'insufficient_text' ELSE concat_ws(',', CASE WHEN glyph > 0.05 THEN 'glyph_indices_detected' END, CASE WHEN alnum < 0.3 THEN 'low_alphanumeric_ratio' END, CASE WHEN found = 0 THEN 'no_common_words' END, CASE WHEN special > 0.3 THEN 'high_special_char_ratio' END) END AS issues,
        stripped > 50 AS has_text FROM {name}_s)"""


def _q(chars: int) -> str:
    return f"{_pages_sql(chars)}, {_quality_sql('pages_', 'q')}, {config.SECTIONS_SQL}, {config.RULES_SQL}"


MATCHES = "CASE WHEN is_readable AND has_text THEN len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) ELSE 0 END"
HOLDS = """CASE condition WHEN 'contains_any' THEN len(list_filter(patterns, lambda p: contains(low, lower(p)))) > 0
  WHEN 'contains_all' THEN len(list_filter(patterns, lambda p: contains(low, lower(p)))) = len(patterns)
  WHEN 'contains_with' THEN contains(low, lower(patterns[1])) AND len(list_filter(patterns[2:], lambda p: contains(low, lower(p)))) > 0
  WHEN 'first_n_pages' THEN page_number - 1 < coalesce(try_cast(patterns[1] AS INT), 5)
  WHEN 'last_n_pages' THEN page_number - 1 >= total_pages - coalesce(try_cast(patterns[1] AS INT), 3)
  WHEN 'regex_match' THEN regexp_matches(low, patterns[1], 'i') ELSE false END"""
BONUS = f"bonus_ AS (SELECT doc_id, page_number, section_id, sum(bonus)::INT AS bonus FROM (SELECT *, CASE WHEN is_readable AND has_text THEN lower(text) ELSE '' END AS low FROM q) q, rules WHERE {HOLDS} GROUP BY ALL)"
SCORES = f"""{BONUS}, scored AS (SELECT q.doc_id, s.section_id, q.page_number, len(keywords) = 0 AS bare, {MATCHES} + coalesce(b.bonus, 0) AS score, min_matches, max_pages
    FROM q CROSS JOIN sections s LEFT JOIN bonus_ b ON b.doc_id = q.doc_id AND b.page_number = q.page_number AND b.section_id = s.section_id),
  scores AS (SELECT doc_id, section_id, page_number, CASE WHEN bare THEN 0 ELSE score END::INT AS score, max_pages FROM scored WHERE CASE WHEN bare THEN page_number <= max_pages ELSE score >= min_matches END),
  top_ AS (SELECT doc_id, section_id, page_number FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id, section_id ORDER BY score DESC, page_number) <= max_pages),
  prim AS (SELECT section_id AS primary_id FROM sections ORDER BY coalesce(priority, 999), ordinal LIMIT 1)"""


def _low(sel: str, name: str) -> str:
    return f"""{name}_lq AS (SELECT doc_id, page_number FROM q WHERE NOT (is_readable AND has_text)),
  {name}_a AS (SELECT * FROM {sel} UNION SELECT doc_id, section_id, page_number FROM (SELECT l.doc_id, s.section_id, l.page_number, max_pages, row_number() OVER (PARTITION BY l.doc_id, s.section_id ORDER BY l.page_number) AS rn
     FROM {name}_lq l CROSS JOIN sections s WHERE extract_signatures AND search_last_pages AND NOT EXISTS (SELECT 1 FROM {sel} t WHERE t.doc_id = l.doc_id AND t.section_id = s.section_id AND t.page_number = l.page_number)) WHERE rn <= max_pages),
  {name} AS (SELECT * FROM {name}_a UNION SELECT doc_id, primary_id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM {name}_lq) l, prim
     WHERE rn <= 5 AND (SELECT count(DISTINCT page_number) FROM {name}_a a WHERE a.doc_id = l.doc_id) < 10)"""


def _cover(sel: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {sel} UNION SELECT q.doc_id, primary_id, q.page_number FROM q CROSS JOIN prim LEFT JOIN (SELECT doc_id, count(DISTINCT page_number) AS used FROM {sel} GROUP BY 1) u ON u.doc_id = q.doc_id
     WHERE is_readable AND has_text AND coalesce(used, 0) / total_pages::DOUBLE < 0.5 AND total_pages <= 50 AND NOT EXISTS (SELECT 1 FROM {sel} t WHERE t.doc_id = q.doc_id AND t.page_number = q.page_number))"""


def _dedup(sel: str, name: str) -> str:
    return f"{name} AS (SELECT t.doc_id, t.section_id, t.page_number FROM {sel} t JOIN sections s USING (section_id) QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.page_number ORDER BY coalesce(priority, 999), ordinal) = 1)"


SELECT_PAGES = f"{_q(400)}, {SCORES}, {_low('top_', 'lowq')}, {_cover('lowq', 'cov')}, {_dedup('cov', 'chosen')}"
FILLED = f"filled AS (SELECT * FROM chosen UNION ALL SELECT q.doc_id, primary_id, page_number FROM q, prim WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc_id = q.doc_id))"
PLAN = f"{SELECT_PAGES}, {FILLED}"

SQL = {
    "content_hashes": f"WITH {DOCS} SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1, substr(sha256(concat_ws(':', sha256(text), source, length(text)::VARCHAR)), 1, 32) AS fingerprint FROM docs",
    "dedup_against_history": f"""WITH {DOCS}, h AS (SELECT doc_id, sha256(text) AS content_hash FROM docs), k AS (SELECT content_hash, min(doc_id) AS orig FROM h WHERE doc_id % 10 = 3 GROUP BY 1),
      n AS (SELECT *, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM h WHERE doc_id % 10 <> 3)
      SELECT doc_id, content_hash, CASE WHEN orig IS NOT NULL OR first_id <> doc_id THEN 'DUPLICATE' ELSE 'STARTED' END AS status, coalesce(orig, CASE WHEN first_id <> doc_id THEN first_id END) AS original_id FROM n LEFT JOIN k USING (content_hash)""",
    "dedup_statements": """WITH d AS (SELECT doc_id, regexp_split_to_array(trim(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' +') AS w, length(coalesce(text, '')) AS n FROM documents),
      s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) u),
      c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      links AS (SELECT x, y FROM p JOIN c ca ON ca.doc_id = x JOIN c cb ON cb.doc_id = y WHERE common / (ca.k + cb.k - common)::DOUBLE >= 0.8)
      SELECT doc_id, n AS n_chars, NOT EXISTS (SELECT 1 FROM links l JOIN d o ON o.doc_id = CASE WHEN l.x = d.doc_id THEN l.y ELSE l.x END WHERE (l.x = d.doc_id OR l.y = d.doc_id) AND (o.n > d.n OR (o.n = d.n AND o.doc_id < d.doc_id))) AS kept FROM d""",
    "multipart_etags": f"""WITH {DOCS}, b AS (SELECT doc_id, encode(text) AS d, octet_length(encode(text)) AS n FROM docs), p AS (SELECT doc_id, n, d, k, md5(d[k * 1000 + 1 : k * 1000 + 1000]) AS h FROM b, LATERAL (SELECT unnest(range(0, greatest(1, ceil(n / 1000.0)::BIGINT))) AS k) u)
      SELECT doc_id, CASE WHEN any_value(n) <= 1000 THEN md5(any_value(d)) ELSE md5(unhex(string_agg(h, '' ORDER BY k))) || '-' || count(*) END AS etag FROM p GROUP BY 1""",
    "paginate": f"WITH {_pages_sql(CHARS)} SELECT doc_id, page_number, total_pages, md5(text) AS text_md5 FROM pages_",
    "page_snippets": f"WITH {_pages_sql(CHARS)} SELECT doc_id, page_number, length({_strip_sql('text')}) > 50 AS has_text, md5({_strip_sql('text')}) AS snippet_md5 FROM pages_",
    "page_quality": f"WITH {_q(CHARS)} SELECT doc_id, page_number, round(quality_score, 6) AS quality_score, is_readable, issues, has_text FROM q",
    "pick_best_parse": f"""WITH {_pages_sql(CHARS)}, broken AS (SELECT doc_id, page_number, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[a-z]', '#', 'g') ELSE text END AS text FROM pages_), {_quality_sql("broken", "a")}, {_quality_sql("pages_", "b")},
      w AS (SELECT a.doc_id, a.page_number, NOT a.is_readable AND b.quality_score > a.quality_score AS other, a.text AS ta, b.text AS tb FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_number = b.page_number)
      SELECT doc_id, page_number, CASE WHEN other THEN 'b' ELSE 'a' END AS parser_used, md5(CASE WHEN other THEN tb ELSE ta END) AS text_md5 FROM w""",
    "token_budget_groups": f"""WITH RECURSIVE {_pages_sql(CHARS)}, t AS (SELECT doc_id, page_number, (length(text[:3000]) // 4 + 10)::INT AS tokens FROM pages_),
      r(doc_id, page_number, tokens, used, group_no) AS (SELECT doc_id, page_number, tokens, tokens, 0 FROM t WHERE page_number = 1 UNION ALL
        SELECT t.doc_id, t.page_number, t.tokens, CASE WHEN r.used + t.tokens > 1000 THEN t.tokens ELSE r.used + t.tokens END, CASE WHEN r.used + t.tokens > 1000 THEN r.group_no + 1 ELSE r.group_no END FROM r JOIN t ON t.doc_id = r.doc_id AND t.page_number = r.page_number + 1)
      SELECT doc_id, page_number, tokens, group_no FROM r""",
    "assemble_context": f"""WITH {_pages_sql(CHARS)}, c AS (SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS t FROM pages_ GROUP BY 1),
      x AS (SELECT doc_id, CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || chr(10) || '[truncated]' ELSE t END AS t FROM c) SELECT doc_id, length(t)::INT AS chars, md5(t) AS context_md5 FROM x""",
    "hybrid_merge": f"""WITH {_q(CHARS)}, g AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page_number) FILTER (is_readable), '') AS r, coalesce(string_agg(text, chr(10) ORDER BY page_number) FILTER (NOT is_readable), '') AS o, count(*) FILTER (is_readable) AS nr, count(*) FILTER (NOT is_readable) AS no_ FROM q GROUP BY 1),
      m AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN nr > 0 THEN '=== TEXT ===' || chr(10) || r END, CASE WHEN no_ > 0 THEN '=== OCR ===' || chr(10) || o END) AS t FROM g)
      SELECT doc_id, CASE WHEN no_ = 0 THEN 'pypdf' WHEN nr = 0 THEN 'textract_ocr' ELSE 'hybrid_pypdf_ocr' END AS method, length(t)::INT AS merged_chars, md5(t) AS merged_md5, length(r) < 500 AND no_ = 0 AS is_scanned FROM m""",
    "slice_first_pages": f"WITH {_pages_sql(CHARS)} SELECT doc_id, md5(substr(string_agg(substr(text, 1, 2000), chr(10) ORDER BY page_number), 1, 10000)) AS head_md5 FROM pages_ GROUP BY 1",
    "billable_pages": f"WITH {_q(CHARS)} SELECT doc_id, count(*) FILTER (is_readable) AS text_pages, count(*) FILTER (NOT is_readable) AS ocr_pages, count(*) AS pages FROM q GROUP BY 1",
    "keyword_matches": f"WITH {_q(CHARS)} SELECT * FROM (SELECT doc_id, page_number, section_id, ({MATCHES})::INT AS matches FROM q, sections) WHERE matches > 0",
    "rule_bonus": f"WITH {_q(CHARS)}, {BONUS} SELECT doc_id, page_number, section_id, bonus FROM bonus_",
    "legacy_defaults": f"WITH {_pages_sql(400)}, {_quality_sql('pages_', 'q')}, rules AS {config.values(profiles.LEGACY_RULES, 'section_id, condition, patterns, bonus')}, {BONUS}, ch AS (SELECT doc_id, section_id, page_number FROM bonus_ WHERE bonus >= 3) SELECT doc_id, 'agreementInfo' AS section_id, page_number FROM pages_ WHERE page_number <= 5 UNION ALL SELECT * FROM ch WHERE section_id <> 'agreementInfo' UNION ALL SELECT doc_id, 'signatures', page_number FROM pages_ WHERE page_number > total_pages - 3 AND doc_id NOT IN (SELECT doc_id FROM ch WHERE section_id = 'signatures')",
    "legacy_bonus_profiles": f"WITH {_pages_sql(400)}, {_quality_sql('pages_', 'q')}, rules AS {config.values(profiles.LEGACY_RULES, 'section_id, condition, patterns, bonus')}, {BONUS} SELECT doc_id, page_number, section_id, bonus FROM bonus_",
    "section_scores": f"WITH {_q(CHARS)}, {SCORES} SELECT doc_id, section_id, page_number, score FROM scores",
    "top_pages": f"WITH {_q(CHARS)}, {SCORES} SELECT * FROM top_",
    "route_low_quality": f"WITH {_q(400)}, {SCORES}, {_low('top_', 'lowq')} SELECT doc_id, section_id, page_number FROM lowq",
    "cover_uncovered": f"WITH {_q(400)}, {SCORES}, {_cover('top_', 'cov')} SELECT doc_id, section_id, page_number FROM cov",
    "dedup_across_sections": f"WITH {_q(400)}, {SCORES}, {_dedup('top_', 'ded')} SELECT * FROM ded",
    "expand_neighbours": f"""WITH {_q(400)}, {SCORES}, {_dedup('top_', 'ded')}, f AS (SELECT doc_id FROM ded GROUP BY 1 HAVING count(DISTINCT page_number) < 5)
      SELECT doc_id, section_id, page_number FROM ded UNION ALL SELECT q.doc_id, primary_id, q.page_number FROM q JOIN f USING (doc_id) CROSS JOIN prim WHERE total_pages > 10
        AND EXISTS (SELECT 1 FROM ded d WHERE d.doc_id = q.doc_id AND abs(d.page_number - q.page_number) = 1) AND NOT EXISTS (SELECT 1 FROM ded d WHERE d.doc_id = q.doc_id AND d.page_number = q.page_number)""",
    "page_selection": f"WITH {SELECT_PAGES} SELECT * FROM chosen",
    "extraction_plan": f"WITH {PLAN} SELECT doc_id, section_id, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS section_pages FROM filled GROUP BY 1, 2",
    "plan_coverage": f"WITH {PLAN} SELECT q.doc_id, count(DISTINCT f.page_number) AS targeted_pages, max(total_pages) AS total_pages, count(DISTINCT f.section_id) AS sections, round(count(DISTINCT f.page_number) / max(total_pages)::DOUBLE, 6) AS share FROM q LEFT JOIN filled f ON f.doc_id = q.doc_id GROUP BY 1",
    "start_page_ranges": f"""WITH {_pages_sql(400)}, {config.SECTIONS_SQL}, st AS (SELECT doc_id, ['s_en', 's_fr', 's_other', 's_es', 's_de'][page_number % 5 + 1] AS section_id, page_number AS start_page, total_pages FROM pages_ WHERE (doc_id * 7 + page_number * 3) % 5 = 0),
      l AS (SELECT st.*, ordinal, max_pages, lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page) AS nxt FROM st LEFT JOIN sections USING (section_id))
      SELECT doc_id, section_id, start_page, greatest(start_page, least(coalesce(nxt - 1, total_pages), start_page + max_pages - 1))::INT AS end_page FROM l WHERE ordinal IS NOT NULL""",
    "classify_by_keywords": f"""WITH {DOCS}, {config.SECTIONS_SQL}, h AS (SELECT doc_id, section_id, ordinal, len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) AS hits FROM docs, sections),
      b AS (SELECT * FROM h WHERE hits >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ordinal) = 1)
      SELECT d.doc_id, coalesce(section_id, 'unknown') AS document_type, coalesce(hits, 0)::INT AS hits, CASE WHEN hits >= 5 THEN 'high' WHEN hits IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence FROM docs d LEFT JOIN b USING (doc_id)""",
    "reclassify_if_empty": f"""WITH {_q(400)}, {SCORES} SELECT d.doc_id, CASE WHEN count(DISTINCT t.section_id) <= 1 OR count(*) FILTER (t.section_id IN ('s_en', 's_de')) = 0 THEN 'loan_agreement' ELSE 'credit_agreement' END AS document_type
      FROM documents d LEFT JOIN top_ t ON t.doc_id = d.doc_id GROUP BY 1""",
}
