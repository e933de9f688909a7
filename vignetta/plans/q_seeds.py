"""Queries over seeds, candidates and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import candidates as Z
from ..operators import seeds as P
from ..sources.fixtures import base, view
from .registry import query

RAW = "SELECT file_seq, line_no, concat(body, '   # ', note) AS line FROM fx_seeds"
PARSED = r"""p AS (SELECT file_seq, line_no, trim(split_part(line, '#', 1)) AS body, trim(substring(line, strpos(line, '#') + 1)) AS note FROM (SELECT file_seq, line_no, concat(body, '   # ', note) AS line FROM fx_seeds) r),
s AS (SELECT file_seq, line_no,
 CASE WHEN body LIKE 'http%' THEN '' ELSE regexp_extract(body, '(\d{4}\.\d{4,5})', 1) END AS arxiv_id,
 CASE WHEN body LIKE 'http%' THEN body ELSE 'https://arxiv.org/pdf/' || regexp_extract(body, '(\d{4}\.\d{4,5})', 1) END AS url,
 CASE WHEN body LIKE 'http%' THEN 'usenix-' || regexp_replace(regexp_extract(body, '([^/]+)$', 1), '\.pdf$', '') ELSE regexp_extract(body, '(\d{4}\.\d{4,5})', 1) END AS key,
 trim(regexp_extract(note, '^([A-Za-z][A-Za-z&/ -]*?)\s*(20\d\d)', 1)) AS venue_hint,
 coalesce(nullif(regexp_extract(note, '^([A-Za-z][A-Za-z&/ -]*?)\s*(20\d\d)', 2), ''), regexp_extract(note, '^(20\d\d)', 1)) AS year_hint, note
 FROM p WHERE NOT starts_with(upper(body), 'NOPDF') AND (body LIKE 'http%' OR regexp_matches(body, '\d{4}\.\d{4,5}'))),
d AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_seq, line_no) AS n FROM s) WHERE n = 1)"""


def _lines(spark, sf):
    return view(spark, sf, "fx_seeds").select("file_seq", "line_no", F.concat("body", F.lit("   # "), "note").alias("line"))


def _seeds(spark, sf):
    return P.parse_seeds(_lines(spark, sf))


def _keyed(spark, sf):
    """Seeds that share keys with the other views: the key of order k is ok."""
    return _seeds(spark, sf).withColumn("key", F.concat(F.lit("o"), F.col("line_no").cast("string")))


KEYED = PARSED + ", k AS (SELECT * REPLACE (concat('o', CAST(line_no AS VARCHAR)) AS key) FROM s)"


def _sidecars(spark, sf):
    return view(spark, sf, "fx_sidecars").withColumn("authors", F.when(F.col("authors_csv") == "", F.array().cast("array<string>")).otherwise(F.split("authors_csv", ";")))


@query("p1_parse_seeds", f"WITH {PARSED} SELECT * FROM s")
def p1(spark, sf):
    return _seeds(spark, sf)


@query("p2_key_for_url", r"""SELECT page_id, h.tag || '-' || coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_extract(regexp_replace(p, '/+$', ''), '([^/]*)$', 1), '\.pdf$', '', 'i'), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 60), ''), 'paper') AS key
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, list_extract(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.'), -2) AS tag FROM pages) h""")
def p2(spark, sf):
    return base(spark, sf, "pages").withColumns(C.url_parts(F.col("url"))).select("page_id", C.key_of_parts().alias("key"))


@query("p3_dedupe_seeds", f"WITH {PARSED} SELECT * FROM d")
def p3(spark, sf):
    return P.dedupe_seeds(_seeds(spark, sf))


@query("p4_seeds_from_ids", f"""WITH {PARSED}, i AS (SELECT c_custkey AS pos, concat('see 2401.', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 'v2') AS id FROM customer)
SELECT * FROM s UNION ALL SELECT 2147483647, pos, substring(id, 5, 10), 'https://arxiv.org/pdf/' || substring(id, 5, 10), substring(id, 5, 10), '', '', '' FROM i""")
def p4(spark, sf):
    ids = base(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("see 2401."), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("v2")).alias("id"))
    return P.seeds_from_ids(_seeds(spark, sf), ids)


@query("p5_need_metadata", f"WITH {KEYED} SELECT * FROM k WHERE arxiv_id <> '' AND key NOT IN (SELECT paper_key FROM fx_sidecars WHERE title <> '')")
def p5(spark, sf):
    return P.need_metadata(_keyed(spark, sf), _sidecars(spark, sf))


@query("p6_merge_sidecars", f"""WITH {KEYED}, a AS (SELECT arxiv_id, max(concat('API ', note)) AS api_title, min(year_hint || '-01-02') AS api_published FROM k WHERE arxiv_id <> '' AND line_no % 3 = 0 GROUP BY arxiv_id)
SELECT paper_key, title, published, url, venue_hint, year_hint, note FROM fx_sidecars WHERE title <> ''
UNION ALL SELECT key, coalesce(api_title, ''), coalesce(api_published, ''), url, venue_hint, year_hint, note FROM k LEFT JOIN a USING (arxiv_id) WHERE key NOT IN (SELECT paper_key FROM fx_sidecars WHERE title <> '')""")
def p6(spark, sf):
    k = _keyed(spark, sf)
    api = k.filter("arxiv_id <> '' AND line_no % 3 = 0").groupBy("arxiv_id").agg(F.max(F.concat(F.lit("API "), "note")).alias("api_title"), F.min(F.concat("year_hint", F.lit("-01-02"))).alias("api_published"))
    return P.merge_sidecars(k, api, _sidecars(spark, sf))


@query("p7_download_plan", f"WITH {KEYED} SELECT * FROM k WHERE key NOT IN (SELECT paper_key FROM fx_pdfs WHERE bytes > 10000) AND key NOT IN (SELECT paper_key FROM fx_sidecars WHERE pdf_pruned)")
def p7(spark, sf):
    return P.download_plan(_keyed(spark, sf), view(spark, sf, "fx_pdfs"), _sidecars(spark, sf))


@query("p8_paper_key", r"""WITH f AS (SELECT body, line_no, CASE WHEN line_no % 2 = 0 THEN body ELSE concat(note, ' x y') END AS stem, line_no % 7 = 0 AS has FROM fx_seeds)
SELECT line_no, CASE WHEN has THEN stem WHEN regexp_matches(stem, '\d{4}\.\d{4,5}') THEN regexp_extract(stem, '(\d{4}\.\d{4,5})', 1) ELSE substring(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) END AS key FROM f""")
def p8(spark, sf):
    stem = F.when(F.col("line_no") % 2 == 0, F.col("body")).otherwise(F.concat("note", F.lit(" x y")))
    return view(spark, sf, "fx_seeds").select("line_no", P.paper_key(stem, F.col("line_no") % 7 == 0).alias("key"))


NORM = "substring(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), 1, {1})"
KNOWN = f"""ki AS (SELECT pdf_arxiv_id AS id FROM fx_papers WHERE pdf_arxiv_id <> '' UNION SELECT paper_key FROM fx_papers UNION SELECT paper_key FROM fx_sidecars),
kt AS (SELECT {NORM.format('pdf_title', 80)} AS t FROM fx_papers UNION SELECT {NORM.format('title', 80)} FROM fx_sidecars)"""
PICK = f"""{KNOWN}, fc AS (SELECT * REPLACE (CASE WHEN cand_id % 3 = 0 THEN replace(title, '!', '') || ': a STUDY' ELSE title END AS title, CASE WHEN cand_id % 8 >= 4 THEN replace(arxiv, '2101.', '2102.') ELSE arxiv END AS arxiv) FROM fx_candidates),
sc AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY citations DESC, cand_id) AS scan_rank FROM fc),
u AS (SELECT *, {NORM.format('title', 80)} AS title_key, coalesce(arxiv, CASE WHEN regexp_matches(oa_url, 'usenix\\.org|arxiv\\.org') THEN oa_url END) AS body FROM sc WHERE scan_rank <= 3000),
f AS (SELECT *, row_number() OVER (PARTITION BY venue, title_key ORDER BY scan_rank) AS n FROM u WHERE body IS NOT NULL AND title_key NOT IN (SELECT t FROM kt) AND (arxiv IS NULL OR arxiv NOT IN (SELECT id FROM ki))),
g AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY scan_rank) AS place FROM f WHERE n = 1)"""


def _picks(spark, sf):
    """Picks from a catalog in which some titles and ids are those of known papers."""
    ids, titles = Z.known_papers(view(spark, sf, "fx_papers"), _sidecars(spark, sf))
    c = view(spark, sf, "fx_candidates")
    cands = c.withColumns({
        "title": F.when(F.col("cand_id") % 3 == 0, F.concat(F.replace("title", F.lit("!"), F.lit("")), F.lit(": a STUDY"))).otherwise(F.col("title")),
        "arxiv": F.when(F.col("cand_id") % 8 >= 4, F.replace("arxiv", F.lit("2101."), F.lit("2102."))).otherwise(F.col("arxiv")),
    })
    venues = cands.select("venue").distinct().withColumns({"short": F.substring("venue", 1, 4), "want": F.lit(40)})
    return Z.pick_top_cited(cands, venues, ids, titles, cap=25)


@query("z1_known_papers", f"WITH {KNOWN} SELECT 'id' AS kind, id AS value FROM ki UNION ALL SELECT 'title', t FROM (SELECT {NORM.format('pdf_title', 80)} AS t FROM fx_papers UNION SELECT {NORM.format('title', 80)} FROM fx_sidecars)")
def z1(spark, sf):
    ids, titles = Z.known_papers(view(spark, sf, "fx_papers"), _sidecars(spark, sf))
    return ids.select(F.lit("id").alias("kind"), F.col("known_id").alias("value")).union(titles.select(F.lit("title"), "known_title"))


@query("z2_pick_top_cited", f"WITH {PICK} SELECT venue, cand_id, place, body, citations FROM g WHERE place <= 25")
def z2(spark, sf):
    return _picks(spark, sf).select("venue", "cand_id", "place", "body", "citations")


@query("z3_render_seed_lines", f"WITH {PICK} SELECT venue, place, body || '   # ' || substring(venue, 1, 4) || ' ' || CAST(year AS VARCHAR) || ' Recent (' || CAST(citations AS VARCHAR) || ' citations): ' || title AS line FROM g WHERE place <= 25")
def z3(spark, sf):
    return Z.render_seed_lines(_picks(spark, sf), recent=True)


NEED = "n AS (SELECT p.paper_key, pdf_arxiv_id AS arxiv_id, coalesce(nullif(s.title, ''), pdf_title) AS title FROM fx_papers p LEFT JOIN fx_sidecars s USING (paper_key) WHERE error IS NULL AND coalesce(authors_csv, '') = '')"
HITS = f"""{NEED}, ha AS (SELECT n.*, cand_id, c.title AS cat_title, citations AS cat_citations, year AS cat_year, venue AS cat_venue FROM n JOIN fx_candidates c ON c.arxiv = n.arxiv_id WHERE arxiv_id <> ''),
ck AS (SELECT *, {NORM.format('title', 60)} AS tk, row_number() OVER (PARTITION BY {NORM.format('title', 60)} ORDER BY citations DESC, cand_id) AS rn FROM fx_candidates),
ht AS (SELECT n.*, cand_id, c.title AS cat_title, citations AS cat_citations, year AS cat_year, venue AS cat_venue FROM n JOIN ck c ON c.rn = 1 AND c.tk = {NORM.format('n.title', 60)} WHERE arxiv_id = '' AND length(n.title) > 12)"""


def _need(spark, sf):
    return Z.enrich_need(view(spark, sf, "fx_papers"), _sidecars(spark, sf))


def _catalog(spark, sf, short=False):
    return view(spark, sf, "fx_candidates")


@query("z4_enrich_need", f"WITH {NEED} SELECT * FROM n")
def z4(spark, sf):
    return _need(spark, sf)


@query("z5_enrich_by_arxiv", f"WITH {HITS} SELECT * FROM ha")
def z5(spark, sf):
    return Z.enrich_by_arxiv(_need(spark, sf), view(spark, sf, "fx_candidates"))


def _studies(spark, sf):
    """A catalog whose titles have the papers' form."""
    return view(spark, sf, "fx_candidates").withColumn("title", F.concat(F.regexp_replace("title", "!", ""), F.lit(": a STUDY")))


STUDIES = HITS.replace("ck AS (SELECT *,", "fs AS (SELECT * REPLACE (regexp_replace(title, '!', '') || ': a STUDY' AS title) FROM fx_candidates), ck AS (SELECT *,").replace("AS rn FROM fx_candidates", "AS rn FROM fs")


@query("z6_enrich_by_title", f"WITH {STUDIES} SELECT * FROM ht")
def z6(spark, sf):
    return Z.enrich_by_title(_need(spark, sf), _studies(spark, sf))


@query("z7_apply_enrichment", f"""WITH {HITS} SELECT s.paper_key, CASE WHEN cat_title IS NOT NULL AND length(s.title) < 8 THEN cat_title ELSE s.title END AS title,
 CASE WHEN cat_title IS NOT NULL THEN 'X Y' ELSE replace(authors_csv, ';', '|') END AS authors, CASE WHEN cat_title IS NOT NULL THEN cat_citations ELSE s.citations END AS citations,
 CASE WHEN cat_title IS NOT NULL AND year_hint = '' THEN CAST(cat_year AS VARCHAR) ELSE s2_year END AS s2_year, cat_venue AS s2_venue FROM fx_sidecars s LEFT JOIN ha USING (paper_key)""")
def z7(spark, sf):
    catalog = view(spark, sf, "fx_candidates").withColumn("authors", F.array(F.lit("X Y"), F.lit("")))
    return Z.apply_by_arxiv(_sidecars(spark, sf), _need(spark, sf), catalog).withColumn("authors", F.array_join("authors", "|"))


@query("z8_enrich_report", f"WITH {STUDIES} SELECT count(*) AS need, count(*) FILTER (paper_key IN (SELECT paper_key FROM ha)) AS by_id, count(*) FILTER (paper_key IN (SELECT paper_key FROM ht)) AS by_title, count(*) FILTER (paper_key NOT IN (SELECT paper_key FROM ha) AND paper_key NOT IN (SELECT paper_key FROM ht)) AS missing FROM n")
def z8(spark, sf):
    need = _need(spark, sf)
    return Z.enrich_report(need, Z.enrich_by_arxiv(need, view(spark, sf, "fx_candidates")), Z.enrich_by_title(need, _studies(spark, sf)))
