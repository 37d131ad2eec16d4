"""Queries of checks, tickets, subtitle files and logs, over items made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as T
from ..operators import graph, lexicon, sense, tickets
from ..operators.tickets import FATAL, FIELDS, HIDDEN, HOPELESS, NAMED, OTHER, QUOTED, WHOLE
from ..sources import logs, transcripts
from .discourse import table
from .lexicon import CXN, constructions
from .registry import query
from .text import WORDS, core, forms_sql


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- contractions, invented quotes, formulas

SPOKEN = "lower(replace(replace(replace(text, ' the ', ' it''s '), ' and ', ' Don’t '), ' of ', ' they''ll '))"
EXPANDED = SPOKEN
for _pattern, _by in C.CONTRACTIONS:
    EXPANDED = f"regexp_replace({EXPANDED}, {quoted(_pattern)}, '{_by.replace('$', chr(92))}', 'g')"


@query(f"SELECT conv_id, turn, md5({EXPANDED}) AS expanded FROM conversations")
def expanded_contractions(spark, sf_dir):
    c = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" it's ")), F.lit(" and "), F.lit(" Don’t ")), F.lit(" of "), F.lit(" they'll "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(C.expand_contractions(c)).alias("expanded"))


MARKS = ("", " (Inferred from context)", " with [to-V]", " [x]", " not in text")
QUOTE = f"text || [{', '.join(map(quoted, MARKS))}][(turn % {len(MARKS)})::INT + 1]"


@query(f"SELECT conv_id, turn, regexp_matches(q, {quoted(C.SLOTS)}) OR " + " OR ".join(f"contains(lower(q), '{x}')" for x in C.INVENTED) + f" AS invented FROM (SELECT *, {QUOTE} AS q FROM conversations)")
def invented_quotes(spark, sf_dir):
    q = F.concat("text", F.element_at(F.array(*map(F.lit, MARKS)), (F.col("turn") % len(MARKS) + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.invented(q).alias("invented"))


FORMS = ("It + [be] + [NP] + that + [S]", "it be [Noun Phrase] that [Subject]", "[NP/Noun] + v/v + [VP]", "[V-ing Phrase], [S] + [V3 / v-ed]", "", "not only ... but also [x", "[Adj/Adverb] of [A/B]")
SLOT = "CASE " + " ".join(f"WHEN {{s}} IN ({', '.join(map(quoted, names))}) THEN '{k}'" for k, names in C.SLOT_NAMES.items()) + " ELSE {s} END"
CLEAN_SLOT = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def slot_sql(x: str) -> str:
    return SLOT.format(s=CLEAN_SLOT.format(x=x))


FORMULAS = f"f AS (SELECT item_id, CASE WHEN n % 2 = 1 THEN upper(t) ELSE t END || ' ' || split_part(text, ' ', n::INT) AS formula, n FROM benchmark, (SELECT unnest([{', '.join(map(quoted, FORMS))}]) AS t, unnest(range(1, {len(FORMS) + 1})) AS n))"
KEY = rf"""rtrim(ltrim(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(lower(formula), '\[[^\]]*\]|[^\[]+|\['), lambda p: CASE WHEN regexp_matches(p, '^\[[^\]]*\]$') THEN '[' || {slot_sql("p[2:-2]")} || ']' ELSE p END), ''), '\+', ' ', 'g'), '\s*,\s*', ',', 'g'), '[^a-z0-9()\[\]/'']+', ' ', 'g'), '\s+', ' ', 'g')), '.'), '.')"""
ONE = f"(len(list_filter(string_split(x, '/'), lambda p: trim(p) <> '')) >= 2 AND len(list_distinct(list_transform(list_filter(string_split(x, '/'), lambda p: trim(p) <> ''), lambda p: {slot_sql('p')}))) = 1)"
BAD = rf"list_transform(list_filter(list_concat(regexp_extract_all(formula, '\[([^\]]+)\]', 1), list_filter(string_split_regex(trim(regexp_replace(formula, '\[[^\]]*\]', ' ', 'g')), '\s+'), lambda w: w <> '')), lambda x: {ONE}), lambda x: trim(x))"


@query(f"WITH {FORMULAS} SELECT item_id, n, {KEY} AS key, array_to_string({BAD}, '|') AS degenerate FROM f")
def formula_keys(spark, sf_dir):
    forms = F.posexplode(F.array(*map(F.lit, FORMS))).alias("p", "t")
    f = table(spark, sf_dir, "benchmark").select("item_id", "text", forms).withColumn("n", (F.col("p") + 1).cast("long"))
    f = f.withColumn("formula", F.concat(F.when(F.col("n") % 2 == 1, F.upper("t")).otherwise(F.col("t")), F.lit(" "), F.split_part("text", F.lit(" "), F.col("n").cast("int"))))
    return f.select("item_id", "n", C.formula_key(F.col("formula")).alias("key"), F.array_join(C.degenerate_slots(F.col("formula")), "|").alias("degenerate"))


# --- shared wording

PAIRS = "pr AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations) WHERE prior IS NOT NULL)"


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("prior", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("prior IS NOT NULL")


TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


@query(f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {TOKENS.format(x='text')} AS a, ' ' || array_to_string({TOKENS.format(x='prior')}, ' ') || ' ' AS t, len({TOKENS.format(x='prior')}) AS nb FROM pr)
    SELECT conv_id, turn, CASE WHEN len(a) = 0 OR nb = 0 THEN 0 ELSE list_max(list_transform(range(1, len(a) + 1), lambda i: len(list_filter(range(0, 29), lambda k: i + k <= len(a) AND contains(t, ' ' || array_to_string(a[i : i + k], ' ') || ' '))))) END::INT AS run FROM w""")
def shared_runs(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", C.longest_shared_run(F.col("text"), F.col("prior")).alias("run"))


GRAM = "list_distinct(list_transform(range(1, len({w}) - 1), lambda j: array_to_string({w}[j : j + 2], ' ')))"


@query(f"""WITH {PAIRS}, c AS (SELECT conv_id, turn, trim({core("array_to_string(string_split(text, ' ')[1 : (1 + turn % 4)], ' ')")}) AS q, {core('prior')} AS s FROM pr), w AS (SELECT *, {WORDS.format(c='q')} AS qw, {WORDS.format(c='s')} AS sw FROM c)
    SELECT conv_id, turn, round(CASE WHEN len(qw) = 0 OR len(sw) = 0 THEN 0.0 WHEN len(qw) < 3 THEN CASE WHEN contains(s, q) THEN 1.0 ELSE len(list_filter(qw, lambda x: list_contains(sw, x))) / len(qw) END ELSE len(list_intersect({GRAM.format(w='qw')}, {GRAM.format(w='sw')})) / len({GRAM.format(w='qw')}) END, 6) AS coverage FROM w""")
def coverage_scores(spark, sf_dir):
    """Share of the 3-grams of a turn's first words that the turn before has."""
    q = F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("turn") % 4 + 1).cast("int")), " ")
    p = pairs(spark, sf_dir).select("conv_id", "turn", T.clean_core(q).alias("q"), T.clean_core(F.col("prior")).alias("s"))
    return p.select("conv_id", "turn", F.round(T.ngram_coverage(F.col("q"), F.col("s")), 6).alias("coverage"))


CUT = "regexp_replace({x}, '(?:ed|ing|s|es|ly|tion|ment)$', '')"


@query(f"""WITH w AS (SELECT item_id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark))), v AS (SELECT a, b FROM w UNION SELECT a, a || 's' FROM w UNION SELECT a, a || 'ing' FROM w),
    c AS (SELECT a, b, {core('a')} AS x, {core('b')} AS y FROM v) SELECT a, b, x <> '' AND y <> '' AND (x = y OR (length({CUT.format(x='x')}) >= 4 AND length({CUT.format(x='y')}) >= 4 AND {CUT.format(x='x')} = {CUT.format(x='y')})) AS same FROM c""")
def stem_pairs(spark, sf_dir):
    w = F.split("text", " ")
    n = table(spark, sf_dir, "benchmark").select(F.explode(F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w)).alias("b"))).alias("p")).select("p.a", "p.b")
    v = n.unionByName(n.select("a", F.concat("a", F.lit("s")).alias("b"))).unionByName(n.select("a", F.concat("a", F.lit("ing")).alias("b"))).distinct()
    return v.select("a", "b", T.same_stem(F.col("a"), F.col("b")).alias("same"))


LIKE = "(x = y OR (length(x) >= 4 AND length(y) >= 4 AND x[1:4] = y[1:4]))"


@query(f"""WITH i AS (SELECT item_id, {WORDS.format(c=core('text'))} AS ws FROM benchmark), h AS (SELECT item_id, [ws[3] || ' ' || ws[4], ws[5], ws[6] || ' ' || ws[7] || ' ' || ws[8]] AS l, unnest([ws[1], ws[4] || 's ' || ws[3], ws[8] || ' ' || ws[9], ws[5]]) AS target, unnest(range(4)) AS n FROM i)
    SELECT item_id, n, target, list_contains(l, target) OR len(list_filter(l, lambda z: len(list_filter(string_split(target, ' '), lambda x: len(list_filter(string_split(z, ' '), lambda y: {LIKE})) = 0)) = 0)) > 0 AS listed FROM h""")
def listed_targets(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(T.clean_core(F.col("text"))).alias("w"))
    at = lambda *i: F.concat_ws(" ", *(F.try_element_at("w", F.lit(k)) for k in i))
    targets = F.array(at(1), F.concat_ws(" ", F.concat(at(4), F.lit("s")), at(3)), at(8, 9), at(5))
    h = w.select("item_id", F.array(at(3, 4), at(5), at(6, 7, 8)).alias("l"), F.posexplode(targets).alias("n", "target"))
    return h.select("item_id", F.col("n").cast("long").alias("n"), "target", C.matches_wordlist(F.col("target"), F.col("l")).alias("listed"))


@query(r"""WITH s AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '') AS tk, regexp_replace(lower(split_part(text, ' ', 2)), '[^a-z]', '', 'g') AS w FROM benchmark),
    v AS (SELECT item_id, tk, list_filter(tk, lambda t: NOT list_contains(f, t) OR length(t) < 3) AS kept FROM (SELECT *, """ + """{forms} AS f FROM s)) SELECT item_id, CASE WHEN len(kept) = len(tk) THEN 1 ELSE 2 END::INT AS n, md5(array_to_string(kept, ' ')) AS kept FROM v""".replace("{forms}", forms_sql("w")))
def source_variants(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select("item_id", C.source_variants(F.col("text"), F.split_part("text", F.lit(" "), F.lit(2))).alias("v"))
    return v.select("item_id", F.size("v").alias("n"), F.md5(F.array_join(F.element_at("v", -1), " ")).alias("kept"))


# --- words, tags, urls, glosses

@query("""WITH f AS (SELECT doc_id, regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:200], '-')), '[a-z]+(?:-[a-z]+)*') AS a, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*') AS b FROM documents), g AS (SELECT doc_id, list_concat(a, b) AS f FROM f)
    SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_concat(f, list_filter(list_transform(f, lambda w: CASE WHEN contains(w, '-') THEN NULL WHEN w = 'granted' THEN 'grant' WHEN w LIKE '%ing' THEN w[:-4] WHEN w LIKE '%ed' THEN w[:-3] END), lambda w: w IS NOT NULL)))), ' ')) AS atoms FROM g""")
def expression_atoms(spark, sf_dir):
    """Of each text, after its first 200 words joined by hyphens."""
    head = F.array_join(F.slice(F.split("text", " "), 1, 200), "-")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.expression_atoms(F.concat(head, F.lit(" "), F.col("text"))), " ")).alias("atoms"))


FRONT = "'tags: [' || lang || ', \"' || source || '\", ' || lang || ', My Tag_' || (doc_id % 7) || '.md,, ]'"


@query(rf"""WITH t AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_extract(CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE {FRONT} END, 'tags:\s*\[(.*?)\]', 1), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(regexp_replace(regexp_replace(trim(x, '"'), '\.md$', '', 'i'), '[\s_]+', '-', 'g'))) AS k FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ',') END AS tags FROM t""")
def document_tags(spark, sf_dir):
    f = F.concat(F.lit("tags: ["), "lang", F.lit(', "'), "source", F.lit('", '), "lang", F.lit(", My Tag_"), F.col("doc_id") % 7, F.lit(".md,, ]"))
    tags = T.normalized_tags(F.when(F.col("doc_id") % 9 == 0, "none").otherwise(f))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


SHARED = "CASE page_id % 4 WHEN 0 THEN 'see ' || url || '.) now' WHEN 1 THEN ' https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=1 ' WHEN 2 THEN 'BV' || substr(md5(url), 1, 10) ELSE substr(md5(url), 1, 11) END"


@query(rf"""WITH r AS (SELECT page_id, trim({SHARED}) AS raw FROM pages), u AS (SELECT page_id, CASE WHEN regexp_matches(raw, '^BV[0-9A-Za-z]{{10}}$') THEN 'https://www.bilibili.com/video/' || raw WHEN regexp_extract(raw, 'https?://[^\s"''<>]+') <> '' THEN regexp_replace(regexp_extract(raw, 'https?://[^\s"''<>]+'), '[.,;!)】\]]+$', '') ELSE raw END AS media FROM r),
    v AS (SELECT *, regexp_extract(media, '(?:youtube\.com/(?:watch\?.*?v=|embed/|shorts/|v/)|youtu\.be/)([0-9A-Za-z_-]{{11}})(?:[?&/#]|$)', 1) AS vid FROM u)
    SELECT page_id, media, regexp_matches(media, '^https?://') AS remote, CASE WHEN vid <> '' THEN vid WHEN regexp_matches(media, '^[0-9A-Za-z_-]{{11}}$') AND NOT regexp_matches(lower(media), '^(http|bv|av)') THEN media END AS video FROM v""")
def media_targets(spark, sf_dir):
    h = F.md5("url")
    kind = F.col("page_id") % 4
    c = F.when(kind == 0, F.concat(F.lit("see "), "url", F.lit(".) now"))).when(kind == 1, F.concat(F.lit(" https://www.youtube.com/watch?v="), F.substring(h, 1, 11), F.lit("&t=1 "))).when(kind == 2, F.concat(F.lit("BV"), F.substring(h, 1, 10))).otherwise(F.substring(h, 1, 11))
    return table(spark, sf_dir, "pages").select("page_id", T.media_url(c).alias("media"), T.is_remote(c).alias("remote"), T.video_id(c).alias("video"))


STOP = ("the", "of", "and", "to", "in")
CONTENT = "CASE WHEN len(list_filter({x}, lambda w: NOT list_contains([" + ", ".join(map(quoted, STOP)) + "], w))) > 0 THEN list_distinct(list_filter({x}, lambda w: NOT list_contains([" + ", ".join(map(quoted, STOP)) + "], w))) ELSE list_distinct({x}) END"


@query(f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+')[1 : (turn % 12)] AS a, regexp_extract_all(lower(prior), '[a-z]+') AS b FROM pr), s AS (SELECT conv_id, turn, {CONTENT.format(x='a')} AS x, {CONTENT.format(x='b')} AS y FROM w)
    SELECT conv_id, turn, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0.0 END, 6) AS ratio FROM s""")
def gloss_overlaps(spark, sf_dir):
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.slice(w("text"), F.lit(1), (F.col("turn") % 12).cast("int")).alias("a"), w("prior").alias("b"))
    return p.select("conv_id", "turn", F.round(sense.overlap_ratio(F.col("a"), F.col("b"), F.array(*map(F.lit, STOP))), 6).alias("ratio"))


CXNS = CXN + ", cx AS (SELECT subcat_group, word, CASE WHEN length(word) % 2 = 0 THEN 'noun' ELSE 'other' END AS pos, (length(word) % 3 - 1)::INT AS sense_idx, 'p' || length(word) AS pattern FROM cxn)"


@query(f"""WITH {CXNS}, nd AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), q AS (SELECT word, CASE WHEN length(word) % 4 = 0 THEN NULL ELSE 'noun' END AS pos, CASE WHEN length(word) % 5 = 0 THEN NULL ELSE 1 END::INT AS sense_idx FROM nd)
    SELECT DISTINCT q.word, q.pos, q.sense_idx, cx.subcat_group, cx.pattern FROM q JOIN cx USING (word) WHERE (q.pos IS NULL OR cx.pos IN ('', 'other') OR cx.pos = q.pos) AND (q.sense_idx IS NULL OR cx.sense_idx = -1 OR cx.sense_idx = q.sense_idx)""")
def construction_rows(spark, sf_dir):
    n = F.length("word")
    c = constructions(spark, sf_dir).select("subcat_group", "word", F.when(n % 2 == 0, "noun").otherwise("other").alias("pos"), (n % 3 - 1).cast("int").alias("sense_idx"), F.concat(F.lit("p"), n).alias("pattern"))
    d = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("t")).select(F.lower("t").alias("word")).distinct()
    d = d.select("word", F.when(n % 4 != 0, "noun").alias("pos"), F.when(n % 5 != 0, 1).alias("sense_idx"))
    return lexicon.cxn_specs(d, c).select("word", "pos", "sense_idx", F.col("c_subcat_group").alias("subcat_group"), F.col("c_pattern").alias("pattern"))


ASKED = "q AS (SELECT turn + 1000 * conv_id AS q_id, array_to_string(string_split(text, ' ')[1:5], ' ') || ' vocabulary unit ' || (conv_id % 90) AS question FROM conversations)"


@query(f"""WITH {ASKED}, n AS (SELECT DISTINCT 'unit_' || regexp_extract(url, '//([^./]+)', 1) || '_' || (page_id % 90) || CASE WHEN page_id % 2 = 0 THEN '_vocabulary' ELSE '' END AS name, CASE WHEN page_id % 2 = 0 THEN 'wiki_vocabulary' ELSE 'other' END AS type FROM pages),
    ts AS (SELECT q_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: length(t) >= 2 OR regexp_matches(t, '^[0-9]+$')) AS ts FROM q), t AS (SELECT q_id, t, count(*) AS n FROM (SELECT q_id, unnest(ts) AS t FROM ts) GROUP BY ALL),
    h AS (SELECT q_id, name, type, sum(t.n * CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 20 ELSE 10 END) AS s FROM n JOIN t ON contains(lower(name), t.t) GROUP BY ALL),
    s AS (SELECT q_id, name, (s + CASE WHEN list_contains(ts, 'vocabulary') AND type = 'wiki_vocabulary' THEN 5 ELSE 0 END)::BIGINT AS score FROM h JOIN ts USING (q_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name)::INT AS place FROM s WHERE score > 15) WHERE place <= 3""")
def routed_questions(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select((F.col("turn") + 1000 * F.col("conv_id")).alias("q_id"), F.concat(F.array_join(F.slice(F.split("text", " "), 1, 5), " "), F.lit(" vocabulary unit "), F.col("conv_id") % 90).alias("question"))
    even = F.col("page_id") % 2 == 0
    n = table(spark, sf_dir, "pages").select(F.concat(F.lit("unit_"), F.regexp_extract("url", "//([^./]+)", 1), F.lit("_"), F.col("page_id") % 90, F.when(even, "_vocabulary").otherwise("")).alias("name"), F.when(even, "wiki_vocabulary").otherwise("other").alias("type"))
    r = graph.route(q, n)
    return r.select("q_id", "name", F.col("score").cast("long").alias("score"), "place")


# --- tickets

FLAGS = (
    "❌ Target word '{w}' does not appear in quoted sentence: '{t}...'",
    "⚠️ Quiz item '{w}': multiple blanks",
    "❌ Quiz item '{w}': Cross-Target Leakage of \"{t}\"",
    "❌ [INSUFFICIENT_ITEMS] 'questions' contains only 3 valid objects",
    "❌ Headword '{w}' is not a recognized English word",
    "❌ item '{w}' Blueprint Self-Conflict",
    "❌ Explanation anchor not grounded near '{t}'",
)
PARTS = [[p for p in f.replace("{w}", "\x01{w}\x01").replace("{t}", "\x01{t}\x01").split("\x01") if p] for f in FLAGS]


def flag_sql() -> str:
    named = {"{w}": "wd", "{t}": "tx"}
    return "CASE n % 7 " + " ".join(f"WHEN {i} THEN " + " || ".join(named.get(p, quoted(p)) for p in ps) for i, ps in enumerate(PARTS)) + " END"


def like_sql(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(n)})" for n in needles) + ")"


SQL_FIELD = "CASE " + " ".join(f"WHEN {like_sql('lower(flag)', ns)} THEN '{field}'" for ns, field in FIELDS) + f" ELSE '{OTHER}' END"
LONG = r"(len(list_filter(string_split_regex(trim(x), '\s+'), lambda w: w <> '')) >= 4 OR length(trim(x)) >= 20)"
SQL_REDACTED = f"trim(array_to_string(list_transform(regexp_extract_all(flag, {quoted('(?s)(?:' + QUOTED.replace('(', '(?:') + '|.)')}), lambda p: CASE WHEN length(p) >= 6 AND {LONG.replace('trim(x)', 'trim(p[2:-2])')} THEN '{HIDDEN}' ELSE p END), ''))"
MADE = f"""tn AS (SELECT conv_id AS quiz_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text, replace(replace(split_part(text, ' ', 3), '.', ''), ',', '') AS w0 FROM conversations), fl AS (SELECT quiz_id, n, {flag_sql()} AS flag FROM (SELECT *, CASE WHEN n % 3 = 0 THEN upper(w0) WHEN n % 5 = 0 THEN 'zzz' ELSE w0 END AS wd, substr(replace(replace(text, chr(39), ''), '"', ''), 1, (10 + n % 30)::INT) AS tx FROM tn)),
    it AS (SELECT quiz_id, list(lower(trim(w0)) ORDER BY n) AS names, list(lower(text) ORDER BY n) AS texts FROM tn GROUP BY quiz_id)"""
SPANS = f"list_filter(list_transform(regexp_extract_all(flag, {quoted(QUOTED)}, 1), lambda s: {{'l': length(s), 's': lower(regexp_replace(trim(s), '[.… ]+$', ''))}}), lambda x: length(x.s) >= 8 AND contains(x.s, ' '))"
TICKETS = f"""{MADE}, nm AS (SELECT fl.*, {SQL_FIELD} AS field, nullif(lower(trim(regexp_extract(flag, {quoted(NAMED)}, 1))), '') AS name, {SPANS} AS sp, names, texts FROM fl JOIN it USING (quiz_id) WHERE contains(flag, '{FATAL}') AND NOT {like_sql('lower(flag)', HOPELESS)}),
    lo AS (SELECT *, list_filter(sp, lambda x: x.l = list_max(list_transform(sp, lambda y: y.l)))[1].s AS part FROM nm),
    lc AS (SELECT *, coalesce(list_filter(range(len(names)), lambda i: names[i + 1] = name)[1], list_filter(range(len(names)), lambda i: names[i + 1][1:4] = name[1:4])[1], list_filter(range(len(texts)), lambda i: contains(texts[i + 1], part) OR (length(part) >= 15 AND contains(texts[i + 1], part[1:15])))[1]) AS spot FROM lo),
    tk AS (SELECT quiz_id, CASE WHEN field = '{WHOLE}' THEN 'questions' ELSE 'questions['|| spot || '].' || field END AS field, {SQL_REDACTED} AS error, min(n) AS n FROM lc WHERE field = '{WHOLE}' OR spot IS NOT NULL GROUP BY ALL),
    rt AS (SELECT quiz_id, row_number() OVER (PARTITION BY quiz_id ORDER BY n, field, error)::INT AS ticket, field, error FROM tk)"""


def made_flags(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("quiz_id"), n.alias("n"), "text", F.replace(F.replace(F.split_part("text", F.lit(" "), F.lit(3)), F.lit("."), F.lit("")), F.lit(","), F.lit("")).alias("w0"))
    wd = F.when(F.col("n") % 3 == 0, F.upper("w0")).when(F.col("n") % 5 == 0, "zzz").otherwise(F.col("w0"))
    tx = F.substring(F.replace(F.replace("text", F.lit("'"), F.lit("")), F.lit('"'), F.lit("")), F.lit(1), F.col("n") % 30 + 10)
    named = {"{w}": wd, "{t}": tx}
    flag = F.coalesce(*(F.when(F.col("n") % 7 == i, F.concat(*(named.get(p, F.lit(p)) for p in ps))) for i, ps in enumerate(PARTS)))
    items = t.groupBy("quiz_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w0", "text"))), lambda x: F.struct(F.array(x["w0"]).alias("names"), F.array(x["text"]).alias("contents"))).alias("items"))
    return t.select("quiz_id", "n", flag.alias("flag")), items


@query(f"WITH {MADE} SELECT quiz_id, n::INT AS n, {SQL_FIELD} AS field, nullif(trim(regexp_extract(flag, {quoted(NAMED)}, 1)), '') AS name, {SQL_REDACTED} AS error FROM fl")
def flag_fields(spark, sf_dir):
    f, _ = made_flags(spark, sf_dir)
    return f.select("quiz_id", "n", tickets.field_of(F.col("flag")).alias("field"), tickets.item_name(F.col("flag")).alias("name"), tickets.redacted(F.col("flag")).alias("error"))


@query(f"WITH {TICKETS} SELECT * FROM rt WHERE ticket <= 5")
def repair_tickets(spark, sf_dir):
    return tickets.repair_tickets(*made_flags(spark, sf_dir), array_key="questions")


@query(f"WITH {TICKETS}, f AS (SELECT quiz_id, field, min(ticket) AS t FROM rt WHERE ticket <= 5 GROUP BY ALL) SELECT quiz_id, string_agg(field, ', ' ORDER BY t) AS fields FROM f GROUP BY quiz_id")
def ticket_mandates(spark, sf_dir):
    return tickets.mandates(repair_tickets(spark, sf_dir))


# --- files

STAMP = "printf('%02d:%02d:%02d,%03d', turn // 60, turn, (turn * 7) % 60, (turn * 37) % 1000)"


@query(f"SELECT 'c' || conv_id AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, round((turn // 60) * 3600 + turn * 60 + (turn * 7) % 60 + ((turn * 37) % 1000) / 1000.0, 3)::DOUBLE AS sec, trim(replace(regexp_replace(text, '\\n\\s*\\n', chr(10), 'g'), chr(10), ' ')) AS text FROM conversations")
def subtitle_lines(spark, sf_dir):
    """Conversations as SubRip files, and their lines read back."""
    t = F.col("turn").cast("int")
    stamp = F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 60).cast("int"), t, t * 7 % 60, t * 37 % 1000)
    block = F.concat(t.cast("string"), F.lit("\n"), stamp, F.lit(" --> "), stamp, F.lit("\n"), F.regexp_replace("text", r"\n\s*\n", "\n"))
    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("b")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n\n").alias("text"))
    out = transcripts.parse_srt(files.select(F.concat(F.lit("c"), "conv_id").alias("file"), "text"))
    return out.select("file", "n", F.round("sec", 3).alias("sec"), "text")


@query(r"""SELECT 'e' || event_id AS log_name, event_type AS task, 'm' || (user_id % 5) AS model, CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN event_id % 4 = 0 THEN 'timeout' END AS failure_category, CASE WHEN event_id % 3 = 0 THEN round(value, 1) END AS pre_cure_score, 'ask ' || event_id AS user_prompt,
    CASE WHEN event_id % 7 <> 6 THEN props END AS response_json FROM events WHERE event_id % 11 <> 0""")
def parsed_logs(spark, sf_dir):
    """Events as log files, read back; every eleventh has no model, every seventh a broken response."""
    e = F.col("event_id")
    raw = F.when(e % 7 == 6, F.lit("{broken")).when(e % 7 == 5, F.concat(F.lit("<think>{no}</think>\nSo:\n```json\n"), "props", F.lit("\n```\nDone."))).when(e % 7 == 4, F.concat(F.lit("Here: "), "props", F.lit(" there."))).otherwise(F.col("props"))
    head = F.concat(F.lit("=== TASK: "), "event_type", F.lit(" ===\n"), F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("=== MODEL: m"), F.col("user_id") % 5, F.lit(" ===\r\n"))), F.when(e % 4 == 0, "=== STATUS: FAILED ===\n=== FAILURE_CATEGORY: timeout ===\n").otherwise(""), F.when(e % 3 == 0, F.concat(F.lit("=== PRE_CURE_SCORE: "), F.round("value", 1), F.lit("% ===\n"))).otherwise(""))
    log = F.concat(head, F.lit("--- SYSTEM PROMPT ---\nbe brief\n--- USER PROMPT ---\nask "), e, F.lit("\n--- RAW RESPONSE ---\n"), raw, F.lit("\n=== END OF LOG ===\n"))
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), e).alias("log_name"), log.alias("text"))
    return logs.parse_logs(files).select("log_name", "task", "model", "status", "failure_category", "pre_cure_score", "user_prompt", "response_json")
