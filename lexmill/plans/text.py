"""Text queries over documents, benchmark items and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quotes
from .registry import query, table

#: clean_core in DuckDB's regular expressions.
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[*_`~]+', ' ', 'g'), '(\.{{2,}}|…)', ' ', 'g'), '[“”‘’"''«»]+', '', 'g'), '\[?\bs-\d+\b\]?[:\-]?', ' ', 'g'), '[\[\](){{}}<>]+', ' ', 'g'), '[\s\p{{Z}}\x1C-\x1F\x{{85}}]+', ' ', 'g'))"""


def core(c: str) -> str:
    return rf"trim(regexp_replace({NORM.format(c=c)}, '[^\p{{L}}\p{{N}}_ ]', '', 'g'))"


#: 3-grams of quotes that are broadcast; some 100 bytes each.
MOST_GRAMS = 1_000_000
WORDS = "list_filter(string_split({c}, ' '), lambda w: w <> '')"


@query(f"SELECT doc_id, length(c) AS n_core, len({WORDS.format(c='c')}) AS n_words, md5(c) AS core_md5 FROM (SELECT doc_id, {core('text')} AS c FROM documents)")
def cleaned_documents(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", T.clean_core(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n_core"), F.regexp_count("c", F.lit("[^ ]+")).cast("long").alias("n_words"), F.md5("c").alias("core_md5"))


def _grams(src: str, n: int = 3) -> str:
    return f"SELECT id, array_to_string(ws[i : i + {n - 1}], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {src})"


@query(f"""WITH q AS (SELECT item_id AS id, {WORDS.format(c=core('text'))} AS ws FROM benchmark), s AS (SELECT doc_id AS id, {WORDS.format(c=core('text'))} AS ws FROM documents),
    qg AS (SELECT DISTINCT * FROM ({_grams('q')})), sg AS (SELECT DISTINCT * FROM ({_grams('s')})), n AS (SELECT id, count(*) AS n FROM qg GROUP BY id),
    p AS (SELECT qg.id AS item_id, sg.id AS doc_id, count(*) AS shared FROM qg JOIN sg ON qg.g = sg.g GROUP BY ALL)
    SELECT item_id, doc_id, shared, shared / n.n AS coverage, shared / n.n >= 0.8 AS verbatim FROM p JOIN n ON n.id = item_id""")
def quote_coverage(spark, sf_dir):
    """Share of each benchmark item's distinct 3-grams that a document has, for all pairs that share one. Pairs come from a
    join on the 3-gram, never from a cross join. The quotes' 3-grams are the small side: they are counted, and broadcast up
    to MOST_GRAMS, so that of the documents' only those that match are shuffled and made distinct; beyond, both sides are."""

    def grams(name: str, key: str):
        c = table(spark, sf_dir, name).select(key, F.regexp_replace(T.clean_core(F.col("text")), " +", " ").alias("c"))
        # at each word's beginning, the word and the two after it; exploded where they are made, as a column of them would
        # be computed again for the filter that Spark puts before an explode
        return c.select(key, F.explode(F.regexp_extract_all("c", F.lit(r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), 1)).alias("g"))

    few = grams("benchmark", "item_id").distinct()
    few = few.join(few.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id")
    few = F.broadcast(few) if few.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS else few
    pairs = grams("documents", "doc_id").join(few, "g")
    out = pairs.groupBy("item_id", "doc_id").agg(F.countDistinct("g").alias("shared"), F.first("n").alias("n"))
    cover = F.col("shared") / F.col("n")
    return out.select("item_id", "doc_id", "shared", cover.alias("coverage"), (cover >= 0.8).alias("verbatim"))


@query(f"""WITH q AS (SELECT item_id, {core('text')} AS c FROM benchmark), s AS (SELECT doc_id, {core('text')} AS c FROM documents)
    SELECT item_id, doc_id FROM q JOIN s ON contains(s.c, q.c)""")
def contained_quotes(spark, sf_dir):
    """Documents that contain a whole benchmark item after cleaning."""
    q = table(spark, sf_dir, "benchmark").select("item_id", T.clean_core(F.col("text")).alias("quote"))
    s = table(spark, sf_dir, "documents").select("doc_id", T.clean_core(F.col("text")).alias("text"))
    return quotes.contained(s, q)


@query(r"""SELECT page_id, CASE WHEN len(p) = 0 THEN url ELSE regexp_replace(CASE WHEN list_position(p, 'wiki') > 0 THEN p[least(list_position(p, 'wiki') + 1, len(p))] WHEN list_position(p, 'raw') > 0 THEN p[least(list_position(p, 'raw') + 1, len(p))] ELSE p[1] END, '(\.md|\.txt)$', '') END AS stem,
    regexp_replace(lower(regexp_replace(split_part(url, '/', -1), '\.(md|txt|html|json)$', '', 'i')), '[^a-z0-9]', '', 'g') AS unit_key FROM (SELECT page_id, url, list_filter(string_split(replace(url, '\', '/'), '/'), lambda x: x <> '') AS p FROM pages)""")
def unit_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.unit_stem(F.col("url")).alias("stem"), T.normalize_name(F.split_part("url", F.lit("/"), F.lit(-1))).alias("unit_key"))


@query(r"""SELECT event_id, CASE WHEN h > 0 THEN printf('[%02d:%02d:%05.2f]', h, m, s) ELSE printf('[%02d:%05.2f]', m, s) END AS stamp, round(h * 3600 + m * 60 + s, 2) AS seconds
    FROM (SELECT event_id, floor(value * 30 / 3600)::INT AS h, floor((value * 30) % 3600 / 60)::INT AS m, (value * 30) % 60 AS s FROM events)""")
def timestamps(spark, sf_dir):
    stamp = T.format_timestamp(F.col("value") * 30)
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), F.round(T.timestamp_seconds(stamp), 2).alias("seconds"))


EN = "SELECT w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') GROUP BY w"


def english_words(spark, sf_dir):
    """Distinct words of English documents and how often they occur."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def forms_sql(w: str = "w") -> str:
    out = [w, *(f"{w} || '{s}'" for s in ("s", "es", "d", "ed", "ing"))]
    out += [f"CASE WHEN {w} LIKE '%y' AND length({w}) > 2 THEN {w}[:-2] || '{s}' END" for s in ("ies", "ied")]
    out += [f"CASE WHEN {w} LIKE '%e' AND length({w}) > 3 THEN {w}[:-2] || '{s}' END" for s in ("ing", "s")]
    for x in ("ies", "ied", "ing", "es", "ed", "s", "d"):
        out += [f"CASE WHEN {w} LIKE '%{x}' AND length({w}) - {len(x)} >= 3 THEN {w}[:-{len(x) + 1}] || '{s}' END" for s in ("", "s", "es", "d", "ed", "ing")]
    return "[" + ", ".join(out) + "]"


@query(f"SELECT w, array_to_string(list_sort(list_distinct(list_filter({forms_sql()}, lambda f: length(f) >= 3))), ' ') AS forms FROM ({EN})")
def word_forms(spark, sf_dir):
    return english_words(spark, sf_dir).select("w", F.array_join(T.inflected_variants(F.col("w")), " ").alias("forms"))
