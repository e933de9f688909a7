"""Views that derive rows of the library's record shapes from the base tables; the SQL reads the same in other engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_seeds": r"""
SELECT CAST(o_orderkey % 3 AS INT) AS file_seq, o_orderkey AS line_no,
 CASE WHEN o_orderkey % 5 = 0 THEN CONCAT('https://www.usenix.org/system/files/osdi', CAST(21 + o_custkey % 6 AS STRING), '-', CAST(o_custkey AS STRING), '.pdf')
      WHEN o_orderkey % 97 = 0 THEN 'NOPDF'
      ELSE CONCAT(CAST(21 + o_custkey % 6 AS STRING), LPAD(CAST(1 + o_custkey % 12 AS STRING), 2, '0'), '.', LPAD(CAST(o_custkey AS STRING), 5, '0')) END AS body,
 CONCAT(CASE o_custkey % 12 WHEN 0 THEN 'NeurIPS ' WHEN 1 THEN 'NIPS ' WHEN 2 THEN 'CHI ' WHEN 3 THEN 'IEEE S&P ' WHEN 4 THEN 'S&P ' WHEN 5 THEN 'USENIX Security '
   WHEN 6 THEN 'SIGGRAPH Asia ' WHEN 7 THEN 'ATC ' WHEN 8 THEN 'Science Robotics ' WHEN 9 THEN 'CSCW ' WHEN 10 THEN 'ICDE ' ELSE '' END,
   CAST(2021 + o_custkey % 6 AS STRING), ' ',
   CASE o_orderpriority WHEN '1-URGENT' THEN 'Best Paper Award' WHEN '2-HIGH' THEN 'Outstanding Paper' WHEN '3-MEDIUM' THEN 'Spotlight'
     WHEN '5-LOW' THEN CONCAT('Recent (', CAST(o_custkey AS STRING), ' citations)') ELSE 'Oral' END,
   ': Title ', CAST(o_custkey AS STRING)) AS note
 FROM orders
""",
    "fx_papers": r"""
SELECT CONCAT('o', CAST(o_orderkey AS STRING)) AS paper_key, CONCAT('Title ', CAST(o_custkey % 900 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ': A Study' ELSE ' - a study.' END) AS pdf_title,
 CASE WHEN o_orderkey % 4 < 2 THEN CONCAT('2101.', LPAD(CAST(o_orderkey AS STRING), 5, '0')) ELSE '' END AS pdf_arxiv_id,
 CASE o_custkey % 4 WHEN 0 THEN 'CVPR' WHEN 1 THEN 'NIPS' WHEN 2 THEN 'SIGGRAPH' ELSE '' END AS pdf_venue,
 CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(2021 + o_orderkey % 5 AS STRING) END AS pdf_year,
 CASE WHEN o_orderkey % 50 = 0 THEN 'parse failure' END AS error,
 CAST(o_orderkey * 10 AS DOUBLE) AS pdf_mtime, CAST(4 + o_orderkey % 2 AS INT) AS extractor_version, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 170 ELSE 300 END AS INT) AS dpi
 FROM orders
""",
    "fx_sidecars": r"""
SELECT CONCAT('o', CAST(o_orderkey AS STRING)) AS paper_key, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CONCAT('Title ', CAST(o_custkey % 900 AS STRING), ': A Study') END AS title,
 CASE WHEN o_orderkey % 4 < 2 THEN CONCAT(CAST(2020 + o_orderkey % 6 AS STRING), '-03-01') ELSE '' END AS published,
 CASE o_custkey % 12 WHEN 0 THEN 'NeurIPS' WHEN 1 THEN 'nips' WHEN 2 THEN 'CHI' WHEN 3 THEN 'IEEE S&P' WHEN 4 THEN 'S&P' WHEN 5 THEN 'USENIX Security' WHEN 6 THEN 'SIGGRAPH Asia'
   WHEN 7 THEN 'ATC' WHEN 8 THEN 'Science Robotics' WHEN 9 THEN 'CSCW' WHEN 10 THEN 'Proc. ICDE' ELSE '' END AS venue_hint,
 CASE WHEN o_orderkey % 7 < 4 THEN CAST(2021 + o_custkey % 6 AS STRING) ELSE '' END AS year_hint, CAST(2019 + o_custkey % 7 AS STRING) AS s2_year,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CHI 2023 Best Student Paper: X' WHEN '2-HIGH' THEN 'CHI 2024 Honourable Mention: X' WHEN '3-MEDIUM' THEN 'ICML 2022 Spotlight: X'
   WHEN '5-LOW' THEN CONCAT('ICDE 2025 Recent (', CAST(o_custkey AS STRING), ' citations): X') ELSE 'High-impact: X' END AS note,
 CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CONCAT('https://arxiv.org/pdf/', CAST(o_orderkey AS STRING)) END AS url,
 CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A One;B Two' ELSE 'A;B;C;D;E;F;G;H' END AS authors_csv, CAST(o_custkey AS BIGINT) AS citations, o_orderkey % 9 = 0 AS pdf_pruned
 FROM orders WHERE o_orderkey % 5 <> 0
""",
    "fx_pdfs": r"""
SELECT CONCAT('o', CAST(o_orderkey AS STRING)) AS paper_key, CAST(o_orderkey * 10 + CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS mtime, CAST(FLOOR(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 4 <> 3
""",
    "fx_figures": r"""
SELECT CONCAT('o', CAST(l_orderkey AS STRING)) AS paper_key, pos, 1 + l_partkey % 12 AS page, CAST(pos AS STRING) AS num,
 CONCAT('o', CAST(l_orderkey AS STRING), '__p', CAST(1 + l_partkey % 12 AS STRING), CASE WHEN l_linenumber = 7 THEN '__tab' ELSE '__fig' END, CAST(pos AS STRING)) AS fig_id,
 CONCAT(CASE WHEN l_linenumber = 7 THEN 'Table ' ELSE 'Figure ' END, CAST(pos AS STRING), ': ',
  CASE l_partkey % 14 WHEN 0 THEN 'Overview of the framework' WHEN 1 THEN 'Accuracy comparison' WHEN 2 THEN 'Qualitative samples' WHEN 3 THEN 'Prompt template'
   WHEN 4 THEN 'Bar chart of latency' WHEN 5 THEN 'Heatmap of attention weights' WHEN 6 THEN 'Learning curves over epochs' WHEN 7 THEN 't-SNE of features'
   WHEN 8 THEN 'Confusion matrix' WHEN 9 THEN 'Screenshot of the interface' WHEN 10 THEN 'Loss landscape contour' WHEN 11 THEN 'Box plot of scores'
   WHEN 12 THEN 'Histogram of errors' ELSE 'A view' END, ' for ', p_name) AS caption,
 l_returnflag = 'R' AS has_raster, CAST(l_quantity AS INT) AS n_drawings, l_linestatus = 'F' AS full_width,
 CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CASE l_suppkey % 7 WHEN 0 THEN 'background' WHEN 1 THEN 'method' WHEN 2 THEN 'example' WHEN 3 THEN 'table' ELSE 'data' END END AS v_category,
 CASE WHEN l_suppkey % 3 = 0 OR l_suppkey % 7 < 4 THEN NULL ELSE CASE l_partkey % 5 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' WHEN 2 THEN 'other' WHEN 3 THEN 'mixed' ELSE 'heatmap' END END AS v_chart_type,
 CASE WHEN l_suppkey % 11 = 0 THEN 'data' END AS v2_category,
 MD5(CONCAT(p_name, '|', CAST(p_size % 4 AS STRING))) AS thumb_md5,
 CAST(200 + p_size * 10 AS INT) AS tw, CAST(150 + p_size * 5 AS INT) AS th, CAST(1000 + l_partkey % 9000 AS BIGINT) AS thumb_bytes
 FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem l) t
 JOIN part ON l_partkey = p_partkey
""",
    "fx_elements": r"""
SELECT CONCAT('o', CAST(l_orderkey AS STRING)) AS paper_key, 1 + l_partkey % 3 AS page, pos AS elem_id,
 CASE l_returnflag WHEN 'R' THEN 'image' WHEN 'A' THEN 'draw' ELSE 'text' END AS elem_type,
 CAST(40 + (l_suppkey * 37) % 300 AS DOUBLE) AS x0, CAST(60 + (l_partkey * 13) % 600 AS DOUBLE) AS y0,
 CAST(40 + (l_suppkey * 37) % 300 + 20 + l_quantity * 4 AS DOUBLE) AS x1, CAST(60 + (l_partkey * 13) % 600 + 10 + l_quantity * 2 AS DOUBLE) AS y1,
 612.0E0 AS page_w, 792.0E0 AS page_h
 FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem l) t
""",
    "fx_blocks": r"""
SELECT paper_key, page, elem_id, x0, y0, x1, y0 + 12 AS y1, page_w, page_h,
 CASE elem_id % 5 WHEN 0 THEN CONCAT('Figure ', CAST(elem_id AS STRING), ': Overview of parts') WHEN 1 THEN CONCAT('Figure ', CAST(elem_id AS STRING), ' shows the parts') WHEN 2 THEN CONCAT('Table ', CAST(elem_id AS STRING), '. Results') ELSE 'Body text of the page' END AS text
 FROM fx_elements e WHERE elem_type = 'text'
""",
    "fx_words": r"""
SELECT CONCAT('o', CAST(l_orderkey AS STRING)) AS paper_key, 1 + l_partkey % 3 AS page, l_suppkey % 4 AS block, l_linenumber % 3 AS line, pos AS word_no,
 CAST(40 + (l_partkey * 17) % 400 AS DOUBLE) AS x0, CAST(40 + (l_partkey * 17) % 400 + 8 + l_quantity AS DOUBLE) AS x1, CAST(100 + (l_suppkey % 4) * 50 + (l_linenumber % 3) * 12 AS DOUBLE) AS y0, CAST(110 + (l_suppkey % 4) * 50 + (l_linenumber % 3) * 12 AS DOUBLE) AS y1, p_name AS word
 FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem l) t JOIN part ON l_partkey = p_partkey
""",
    "fx_responses": r"""
SELECT fig_id, CONCAT(CASE WHEN pos % 2 = 0 THEN '```json' ELSE '' END, '{"category": "', CASE WHEN n_drawings % 9 = 0 THEN 'Chart' ELSE COALESCE(UPPER(v_category), 'data') END, '", "chart_type": "', COALESCE(v_chart_type, 'sunburst'),
 '", "tags": ', CASE WHEN pos % 3 = 0 THEN '"Log scale, Icons ,,legend"' ELSE '["Error Bars", " icons ", ""]' END, ', "summary_zh": "s"}', CASE WHEN pos % 2 = 0 THEN '```' ELSE '' END) AS reply FROM fx_figures f
""",
    "fx_candidates": r"""
SELECT c_mktsegment AS venue, CONCAT('Title ', CAST(o_custkey % 500 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END) AS title,
 CAST(FLOOR(o_totalprice / 100) AS BIGINT) AS citations, CAST(2021 + o_orderkey % 6 AS INT) AS year,
 CASE WHEN o_orderkey % 4 < 2 THEN CONCAT('2101.', LPAD(CAST(o_orderkey AS STRING), 5, '0')) END AS arxiv,
 CASE o_orderkey % 4 WHEN 2 THEN CONCAT('https://www.usenix.org/f/', CAST(o_orderkey AS STRING), '.pdf') WHEN 3 THEN 'https://dl.acm.org/doi/pdf/1' END AS oa_url, o_orderkey AS cand_id
 FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_visits": r"""
SELECT event_id, ts, user_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN '' ELSE 'a=1; pf_v=1' END AS cookie FROM events WHERE event_type IN ('view','click')
""",
}

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needed(sql: str) -> list[str]:
    """Views that sql names, directly or through others, each after those it reads."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in found:
                add(VIEWS[name])
                found.append(name)

    add(sql)
    return found


def with_views(sql: str) -> str:
    """sql with the views it names in front as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **rows: DataFrame) -> DataFrame:
    """One of VIEWS over the tables in sf_dir; `rows` gives other rows for some of them."""
    sql = with_views(f"SELECT * FROM {name}")
    for t in BASE:
        if re.search(rf"\b{t}\b", sql):
            (rows[t] if t in rows else base(spark, sf_dir, t)).createOrReplaceTempView(t)
    return spark.sql(sql)
