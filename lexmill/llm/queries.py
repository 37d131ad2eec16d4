"""The queries of the operators of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, infill, lines, merkle, mixing, passages, prefixes, quality, simhash, topk, toxicity, urls
from .common import table
from .labels import held_out

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_and_pattern(name: str = RANKS) -> tuple[bytes, str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=True)
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = ranks_and_pattern()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, ids=False, digests=True)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score_documents(docs, model).select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = merkle.Manifest(docs, merkle.even_crc(F.col("doc_id"))).proofs()
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = prefixes.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    return prefixes.count_tokens(table(spark, sf_dir, "documents"), spec, limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_line_dedup, op3_simhash, op4_bpe, op5_topk, op6_mixing, op7_ann, op8_substring_dedup, op9_toxicity, op10_quality, op11_merkle, op12_infill, op13_prefix_counts)}


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


#: The CRC-32 of an id's digits: a bit at a time, the reflected polynomial.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": """
            WITH p AS (SELECT page_id,
                coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r AS (SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM p)
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
        "op2_line_dedup": """
            WITH l AS (SELECT doc_id, coalesce('s' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
            k AS (SELECT doc_id, site, pos, line, trim(line) AS key, regexp_matches(line, '^\\s*(\\S+\\s+){2}\\S') AS long_enough FROM l),
            b AS (SELECT key, min((doc_id, pos)) AS first FROM k WHERE long_enough GROUP BY key HAVING count(DISTINCT site) >= 5),
            m AS (SELECT k.*, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b ON k.key = b.key AND k.long_enough)
            SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256 FROM m GROUP BY doc_id
            UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
        "op5_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
        "op6_mixing": f"""
            WITH d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
            c AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cb, coalesce(sum(w) OVER b, 0) AS wb, sum(source_size) OVER () AS t, sum(w) OVER () AS wa FROM w
                WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            e AS (SELECT *, max(CASE WHEN (t - cb) / (wa - wb) * w <= cap THEN (t - cb) / (wa - wb) END) OVER () AS lev FROM c),
            g AS (SELECT source, source_size, CASE WHEN lev IS NULL OR lev * w > cap THEN cap ELSE lev * w END AS target FROM e),
            n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM g),
            r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
            SELECT doc_id, source, size, source_size, target, (size * (copies + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
        "op8_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
            k AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS t FROM w),
            m AS (SELECT t, min(doc_id) AS low FROM k GROUP BY t HAVING min(doc_id) < max(doc_id)),
            g AS (SELECT DISTINCT k.doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN m ON k.t = m.t AND k.doc_id > m.low),
            x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
            y AS (SELECT x.doc_id, count(*) AS n, count(g.i) AS gone, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '') AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
            SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id""",
        "op11_merkle": rf"""
            WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, text,
                    sha256(concat_ws('', x.doc, x.src, x.lng, x.chr, coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
                    CASE WHEN tamper THEN sha256(concat_ws('', x.doc, x.src, x.lng, x.chr, coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-'))) END AS changed
                FROM (SELECT *, {{'doc': coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-'), 'src': coalesce(octet_length(encode(source)) || ':' || source, '-'), 'lng': coalesce(octet_length(encode(lang)) || ':' || lang, '-'), 'chr': coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-')}} AS x,
                    coalesce({CRC32} % 2 = 0, false) AS tamper FROM documents)),
            p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
            up AS (SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM p
                UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 2) // 3 FROM up WHERE size > 1 GROUP BY tree, level, idx // 3),
            tops AS (SELECT tree, h AS subroot, level AS top FROM up WHERE size = 1),
            above AS (SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, subroot AS h, count(*) OVER () AS size FROM tops
                UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 2) // 3 FROM above WHERE size > 1 GROUP BY level, idx // 3),
            nodes AS (SELECT tree, level, idx, h FROM up WHERE size > 1 UNION ALL SELECT t.tree, 1000 + a.level, a.idx, a.h FROM above a, (SELECT -1 AS tree) t WHERE size > 1),
            runs AS (SELECT tree, level, idx, coalesce(string_agg(h, '' ORDER BY idx) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '' ORDER BY idx) OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                FROM nodes WINDOW b AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)),
            down AS (SELECT r, p.tree, 0 AS level, idx, coalesce(changed, leaf) AS h, '' AS proof, subroot, p.tree - 1 AS at_top, false AS done, top FROM p JOIN tops USING (tree)
                UNION ALL SELECT r, CASE WHEN level = top THEN -1 ELSE w.tree END, CASE WHEN level = top THEN 1000 ELSE level + 1 END, CASE WHEN level = top THEN at_top ELSE w.idx // 3 END,
                    CASE WHEN level = top THEN w.h WHEN n.before IS NULL THEN w.h ELSE sha256(n.before || w.h || n.after) END, CASE WHEN level = top THEN proof WHEN n.before IS NULL THEN proof ELSE proof || n.before || n.after END, subroot, at_top,
                    level <> top AND n.before IS NULL, CASE WHEN level = top THEN -1 ELSE top END
                FROM (SELECT *, CASE WHEN level = top THEN -2 ELSE tree END AS k FROM down) w LEFT JOIN (SELECT tree AS k, level AS l, idx AS i, before, after FROM runs) n ON n.k = w.k AND n.l = w.level AND n.i = w.idx WHERE NOT done)
            SELECT doc_id, leaf, subroot, a.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = a.h AS verified FROM down w JOIN p USING (r), above a WHERE w.done AND a.size = 1""",
        "op12_infill": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            g AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x FROM d),
            c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS i, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS j,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
            s AS (SELECT *, array_to_string(u[1 : i], '') AS p, array_to_string(u[i + 1 : j], '') AS m, array_to_string(u[j + 1 : n], '') AS e FROM c)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
    }
