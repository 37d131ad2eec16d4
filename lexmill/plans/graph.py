"""Link and file queries over the pages. A page is a document, its links are the hrefs of its html; a file is a page's url."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

LINKS = """lk AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS n FROM pages),
    links AS (SELECT page_id AS doc_id, n::INT AS n, trim(t) AS target FROM lk)"""


def hrefs(spark, sf_dir):
    return graph.links(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"), "html", graph.HREF)


@query(f"WITH {LINKS} SELECT * FROM links")
def page_links(spark, sf_dir):
    return hrefs(spark, sf_dir)


@query(f"WITH {LINKS}, valid AS (SELECT DISTINCT '/' || unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark) SELECT target, doc_id, n FROM links ANTI JOIN valid ON name = target WHERE NOT starts_with(target, 'http')")
def broken_page_links(spark, sf_dir):
    """Links to words that no benchmark item has."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return graph.broken_links(hrefs(spark, sf_dir), words.select(F.concat(F.lit("/"), "w").alias("name")))


#: Nodes: pages, each labelled by its first link.
EDGES = LINKS + """, nodes AS (SELECT doc_id AS id, target AS label FROM links WHERE n = 0), fst AS (SELECT lower(label) AS l, min(id) AS target FROM nodes GROUP BY ALL),
    edges AS (SELECT DISTINCT doc_id AS source, fst.target FROM links JOIN fst ON lower(links.target) = l WHERE doc_id <> fst.target)"""


def edges(spark, sf_dir):
    found = hrefs(spark, sf_dir)
    nodes = found.where("n = 0").select(F.col("doc_id").alias("id"), F.col("target").alias("label"), F.col("doc_id").alias("ord"))
    return graph.edges(found.select(F.col("doc_id").alias("source"), "target"), nodes)


@query(f"WITH {EDGES} SELECT * FROM edges")
def link_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {EDGES} SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id")
def link_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


LAST = "split_part(url, '/', -1)"
STEM = r"regexp_replace({c}, '\.[^./]*$', '')"


@query(f"""WITH s AS (SELECT {LAST} AS k FROM pages WHERE starts_with(url, 'https')), known AS (SELECT k FROM s UNION SELECT {STEM.format(c='k')} FROM s)
    SELECT url AS path FROM pages GROUP BY url HAVING NOT bool_or(coalesce({LAST} IN (SELECT k FROM known) OR {STEM.format(c=LAST)} IN (SELECT k FROM known), false))""")
def orphan_files(spark, sf_dir):
    """Urls whose last part is that of no https url."""
    p = table(spark, sf_dir, "pages")
    last = F.split_part("url", F.lit("/"), F.lit(-1))
    return graph.orphans(p.select(F.col("url").alias("path"), last.alias("source")), p.where(F.startswith("url", F.lit("https"))).select(last.alias("name")))


INVENTORY = r"""f AS (SELECT url AS path, replace(url, '\', '/') AS p FROM pages), k AS (SELECT *, split_part(p, '/', -1) AS name FROM f),
    ty AS (SELECT path, p, regexp_replace(name, '\.[^.]*$', '') AS stem, CASE WHEN contains(name, '_vocabulary') THEN 'wiki_vocabulary' WHEN contains(name, '_grammar') THEN 'wiki_grammar' WHEN contains(name, '_summary') THEN 'wiki_summaries' WHEN contains(p, '/sources/') THEN 'source' ELSE 'other' END AS type FROM k),
    inv AS (SELECT unnest(CASE WHEN type = 'source' THEN [p, stem] ELSE [stem] END) AS name, type, path FROM ty)"""


@query(f"WITH {INVENTORY} SELECT * FROM inv")
def file_inventory(spark, sf_dir):
    return graph.inventory(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
