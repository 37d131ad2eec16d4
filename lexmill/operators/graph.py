"""The graph of linked documents: nodes, edges, broken links, orphans, inventory, routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quotes import contained

WIKILINK = r"\[\[(.*?)(?:\|.*?)?\]\]"
HREF = r'<a href="([^"]*)"'


def links(docs: DataFrame, text: str, pattern: str = WIKILINK) -> DataFrame:
    """doc_id, n (place), target."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("n", "t")).select("doc_id", "n", F.trim("t").alias("target"))


def broken_links(found: DataFrame, valid: DataFrame) -> DataFrame:
    """Links whose target is no valid name (column name) and no url."""
    return found.where(~F.startswith("target", F.lit("http"))).join(valid.select(F.col("name").alias("target")).distinct(), "target", "left_anti")


def edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target: node ids, without loops and repeats. A link goes to the first node (by ord) of its label, case
    aside. found: source, target (a label); nodes: id, label, ord."""
    first = nodes.groupBy(F.lower("label").alias("l")).agg(F.min_by("id", "ord").alias("to"))
    j = found.join(first, F.lower(F.trim("target")) == F.col("l")).where(F.col("source") != F.col("to"))
    return j.select("source", F.col("to").alias("target")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """id, n_out, n_in of all ends of edges."""
    both = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def orphans(compiled: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths (distinct) of compiled files without a source. compiled: path, source (a name with or without its ending);
    sources: name."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    known = sources.select(F.col("name").alias("k")).unionByName(sources.select(stem.alias("k"))).distinct()
    c = compiled.select("path", F.explode(F.array_distinct(F.array("source", F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^./]*$", "")))).alias("k"))
    return compiled.select("path").distinct().join(c.join(known, "k").select("path").distinct(), "path", "left_anti")


def inventory(files: DataFrame) -> DataFrame:
    """name, type, path from the paths of files; a source is listed by its path and by its stem."""
    p = F.regexp_replace("path", r"\\", "/")
    name = F.element_at(F.split(p, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    kind = F.when(F.contains(name, F.lit("_vocabulary")), "wiki_vocabulary").when(F.contains(name, F.lit("_grammar")), "wiki_grammar").when(F.contains(name, F.lit("_summary")), "wiki_summaries").when(F.contains(p, F.lit("/sources/")), "source").otherwise("other")
    named = F.when(kind == "source", F.array(p, stem)).otherwise(F.array(stem))
    return files.select("path", kind.alias("type"), F.explode(named).alias("name")).select("name", "type", "path")


def question_tokens(question: Column) -> Column:
    """Words of two letters and more, numbers, and single CJK characters, in order, repeats kept."""
    w = F.filter(F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9]+)"), 1), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))
    return F.concat(w, F.regexp_extract_all(question, F.lit("([一-鿿])"), 1))


#: A token that is in this share of the names or more is frequent.
FREQUENT = 0.25


def route(questions: DataFrame, names: DataFrame, count: int = 3, least: int = 15) -> DataFrame:
    """q_id, name, score, place: the items that a question is about. A token in a name counts 10, a number 20, a type named in
    the question 5; over `least`; the first `count` by score, then name. Distinct tokens are looked for in
    each distinct name at once, so no name is held against each token.

    Questions that have the same tokens of names are answered once. Names with a token that isn't frequent are scored. Of all
    others the score depends on their type and frequent tokens alone, so that of the names that are the same in these the
    first `count` are enough: each of them scores as much and stands before the rest."""
    boost = {"vocabulary": "wiki_vocabulary", "grammar": "wiki_grammar", "summary": "wiki_summaries"}
    q = questions.select("q_id", question_tokens(F.col("question")).alias("ts"))
    t = q.select("q_id", F.array_intersect("ts", F.array(*map(F.lit, boost))).alias("kinds"), F.explode("ts").alias("t")).groupBy("q_id", "kinds", "t").agg(F.count(F.lit(1)).alias("n"))
    items = names.select("name", "type").distinct()
    distinct = t.select("t").distinct()
    found = contained(items.select(F.col("name").alias("doc_id"), F.lower("name").alias("text")).distinct(), distinct.select(F.xxhash64("t").alias("item_id"), F.col("t").alias("quote")))
    found = found.join(distinct, F.xxhash64("t") == F.col("item_id")).select(F.col("doc_id").alias("name"), "t").where(F.contains(F.lower("name"), F.col("t"))).distinct()
    all_names = items.agg(F.countDistinct("name").alias("all"))
    held = found.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(all_names).select("t", (F.col("df") >= F.col("all") * FREQUENT).alias("frequent"))

    points = F.col("n") * F.when(F.col("t").rlike("^[0-9]+$"), 20).otherwise(10)
    asked = t.join(held, "t").groupBy("q_id", "kinds").agg(F.array_sort(F.collect_list(F.struct("t", points.alias("points"), "frequent"))).alias("toks")).withColumn("kinds", F.array_sort("kinds"))
    once = asked.select("toks", "kinds").distinct()
    seldom = once.select("toks", "kinds", F.explode(F.filter("toks", lambda x: ~x["frequent"])["t"]).alias("t"))
    scored = seldom.join(found, "t").select("toks", "kinds", "name").distinct().join(items, "name")

    often = found.join(held.where("frequent"), "t").groupBy("name").agg(F.array_sort(F.collect_list("t")).alias("often"))
    alike = items.join(often, "name", "left").withColumn("k", F.row_number().over(Window.partitionBy("type", "often").orderBy("name"))).where(F.col("k") <= count)
    others = once.crossJoin(alike.select("name", "type"))

    hits = F.aggregate("toks", F.lit(0).cast("long"), lambda a, x: a + F.when(F.contains(F.lower("name"), x["t"]), x["points"]).otherwise(0))
    more = sum((F.when(F.array_contains("kinds", k) & (F.col("type") == v), 5).otherwise(0) for k, v in boost.items()), F.lit(0))
    s = scored.unionByName(others).select("toks", "kinds", "name", "type", hits.alias("s"), more.alias("more")).distinct()
    s = s.where((F.col("s") > 0) & (F.col("s") + F.col("more") > least)).withColumn("score", F.col("s") + F.col("more"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("toks", "kinds").orderBy(F.desc("score"), "name"))).where(F.col("place") <= count)
    return asked.join(s.select("toks", "kinds", "name", "score", "place"), ["toks", "kinds"]).select("q_id", "name", "score", "place")
