"""The operators bound to the test tables: query name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.llm.centroid_clusters import centroid_clusters
from chainlens.llm.decontaminate import benchmark_verdicts
from chainlens.llm.exact_dedup import exact_dedup
from chainlens.llm.language_id import language_id
from chainlens.llm.merkle import manifest
from chainlens.llm.mixing import mix_sources
from chainlens.llm.ngram_join import ngram_jaccard_classes
from chainlens.llm.quality import quality_scores
from chainlens.llm.substring_dedup import repeated_passages
from chainlens.llm.token_cache import cached_token_counts
from chainlens.llm.token_output import token_output
from chainlens.llm.url_filter import filter_urls
from chainlens.llm.warc import warc_round_trip

#: file name and end id of the tokenizer the pipeline and op9 write
OUTPUT_TOKENIZER, OUTPUT_END = "byte_bpe_50k.json", 2
#: (action, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))
COUNT_TOKENIZER = "word_bpe_49k.json"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard_classes(_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("bucket_depth")


def op3_substring_dedup(spark, sf_dir):
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc_round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark, sf_dir):
    return cached_token_counts(_table(spark, sf_dir, "documents"), COUNT_TOKENIZER)


def op6_url_filter(spark, sf_dir):
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_mixing(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return benchmark_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop(
        "text_hash")


def op9_token_output(spark, sf_dir):
    return token_output(_table(spark, sf_dir, "documents"), OUTPUT_TOKENIZER, OUTPUT_END)


def op10_quality(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    return language_id(_table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def op12_centroid_clusters(spark, sf_dir):
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_quality": op10_quality,
    "op11_language_id": op11_language_id,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _clusters(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """SQL of op12: each round is an assignment of long rows (vector, component) and a new table of centroids."""
    ctes = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT v, unnest(range({dims})) AS j, unnest(x) AS x FROM kept),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, v FROM kept
            QUALIFY c < {k}),
        m0 AS MATERIALIZED (SELECT c, j, x FROM c0 JOIN part USING (v))"""]
    for r in range(rounds + 1):
        ctes.append(f"""
        a{r} AS MATERIALIZED (
            SELECT v, min({{'d': d, 'c': c}}) AS near FROM (
                SELECT v, c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM part p JOIN m{r} m USING (j) GROUP BY v, c)
            GROUP BY v)""")
        if r < rounds:
            ctes.append(f"""
        m{r + 1} AS MATERIALIZED (
            SELECT m.c, m.j, coalesce(s.t // s.n - CASE WHEN s.t % s.n < 0 THEN 1 ELSE 0 END, m.x) AS x FROM m{r} m
            LEFT JOIN (SELECT near.c AS c, j, sum(x)::BIGINT AS t, count(*) AS n FROM a{r} JOIN part USING (v) GROUP BY ALL) s
            ON s.c = m.c AND s.j = m.j)""")
    return f"""WITH {",".join(ctes)},
        named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS sha FROM m{rounds} GROUP BY c)
        SELECT vec_id, near.c::INT AS cluster, near.d::BIGINT AS distance,
               sum(near.d) OVER (PARTITION BY near.c)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia,
               sha AS centroid_sha256
        FROM a{rounds} JOIN kept USING (v) JOIN named ON named.c = near.c"""


def _framed(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


#: CRC-32 of an ASCII text, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)),
                lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"""

_MERKLE = f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS d, doc_id, lang, {_framed("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
                   CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {_framed("doc_id", "source", "lang", "n_chars",
                        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
            FROM documents),
        placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                   count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        node AS (
            SELECT lang, 0 AS level, place, n, leaf AS h FROM placed
            UNION ALL
            SELECT lang, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place))
            FROM node WHERE n > 1 GROUP BY lang, level, place // 8, n),
        low AS MATERIALIZED (SELECT * FROM node),
        sub AS MATERIALIZED (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n, level
            FROM low WHERE n = 1),
        peak AS (
            SELECT 0 AS level, place, n, subroot AS h FROM sub
            UNION ALL
            SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place))
            FROM peak WHERE n > 1 GROUP BY level, place // 8, n),
        high AS MATERIALIZED (SELECT * FROM peak),
        steps AS (
            SELECT p.d, s.level, coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place < p.place >> (3 * s.level)), '') AS l,
                   coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place > p.place >> (3 * s.level)), '') AS r
            FROM placed p JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.n > 1
             AND s.place // 8 = p.place >> (3 * s.level + 3) GROUP BY p.d, s.level, p.place
            UNION ALL
            SELECT p.d, sub.level + s.level,
                   coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place < sub.place >> (3 * s.level)), ''),
                   coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place > sub.place >> (3 * s.level)), '')
            FROM placed p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN high s ON s.n > 1
             AND s.place // 8 = sub.place >> (3 * s.level + 3) GROUP BY p.d, sub.level, s.level, sub.place),
        path AS MATERIALIZED (
            SELECT p.d, any_value(p.doc_id) AS doc_id, any_value(p.lang) AS lang, any_value(p.leaf) AS leaf,
                   sha256(coalesce(string_agg(s.l || s.r, '' ORDER BY s.level), '')) AS proof_sha256,
                   list_reduce(list_prepend([coalesce(any_value(p.changed), any_value(p.leaf))],
                       coalesce(list([s.l, s.r] ORDER BY s.level) FILTER (s.level IS NOT NULL), [])),
                       lambda a, s: [sha256(s[1] || a[1] || s[2])])[1] AS folded_root
            FROM placed p LEFT JOIN steps s ON s.d = p.d GROUP BY p.d)
        SELECT doc_id, leaf, subroot, top.h AS root, proof_sha256, folded_root, folded_root = top.h AS verified
        FROM path JOIN sub ON sub.lang IS NOT DISTINCT FROM path.lang, (SELECT h FROM high WHERE n = 1) AS top"""

#: the queries that SQL can express (op3, op5, op6, op7, op9, op10 and op11 have models or libraries in them)
ORACLE = {
    "op1_ngram_jaccard": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))),
                lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach AS (
            SELECT a AS doc_id, b AS other FROM links
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles,
               least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id
        GROUP BY d.doc_id""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS top,
                     array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                         ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '')
                     AS payload_digest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op8_decontamination": rf"""
        WITH item AS (
            SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        phrase AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(greatest(len(w) - 12, 1)),
                lambda i: array_to_string(w[i + 1 : i + 13], ' '))) AS p FROM item WHERE len(w) > 0),
        doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        spot AS (
            SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i
            FROM doc, (SELECT DISTINCT k FROM phrase) WHERE len(w) >= k),
        met AS (
            SELECT a.doc_id, a.i, a.k, f.item_id FROM spot a
            JOIN phrase f ON f.k = a.k AND f.p = array_to_string(a.w[a.i + 1 : a.i + a.k], ' ')),
        hit AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met)
            GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM doc d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op12_centroid_clusters": _clusters(),
    "op13_merkle_manifest": _MERKLE,
}
