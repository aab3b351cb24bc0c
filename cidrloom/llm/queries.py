"""The thin queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from cidrloom.llm import op2_quality, op5_urls, op6_language
from cidrloom.llm.op1_suffix import dedup as op1_dedup
from cidrloom.llm.op3_jaccard import grouped as op3_grouped
from cidrloom.llm.op4_bpe import tokenise as op4_tokenise
from cidrloom.llm.op7_decontaminate import matches as op7_matches
from cidrloom.llm.op8_pii import find as op8_pii_find
from cidrloom.llm.op9_toxicity import score as op9_score
from cidrloom.llm.op10_warc import round_trip as op10_round_trip
from cidrloom.llm.op11_trie import trie as op11_trie
from cidrloom.llm.op12_variants import variants as op12_variants
from cidrloom.llm.op13_topk import top_k as op13_top_k
from cidrloom.llm.kit import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_quality_rules(spark, sf_dir):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_share", "longest_repeat"]
    return op2_quality.quality(table(spark, sf_dir, "documents")).select(cols)


@query
def op5_url_filter(spark, sf_dir):
    return op5_urls.judge(table(spark, sf_dir, "pages"))


@query
def op6_language_id(spark, sf_dir):
    return op6_language.predict(table(spark, sf_dir, "documents"))


@query
def op8_pii_spans(spark, sf_dir):
    return op8_pii_find(table(spark, sf_dir, "documents"))


@query
def op10_warc_zstd(spark, sf_dir):
    rows = op10_round_trip(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_toxicity(spark, sf_dir):
    return op9_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark, sf_dir):
    return op7_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_bpe(spark, sf_dir):
    return op4_tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


@query
def op3_jaccard_join(spark, sf_dir):
    groups = op3_grouped(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op1_suffix_dedup(spark, sf_dir):
    return op1_dedup(table(spark, sf_dir, "documents")).drop("kept")

# CRC-32 of a list of bytes `b` as DuckDB text: reflected, polynomial 0xEDB88320, by a table `t` of 256 entries.
_CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) ORDER BY i) AS t
    FROM range(256) r(i)
)"""
_CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda v, x: xor(v // 256, t[xor(v, x) % 256 + 1])), 4294967295)"


@query
def op11_prefix_trie(spark, sf_dir):
    return op11_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = f"""
WITH {_CRC_TABLE}, turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
    SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS b FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM digits, crc_table
), kept AS (
    SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos < h.h WHERE h.base <> h.conv_id
    UNION ALL
    SELECT h.conv_id, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND (t.pos >= h.h OR h.base = h.conv_id)
), rebuilt AS (
    SELECT *, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS path FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), nodes AS (
    SELECT path, depth, path[:depth - 1] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS bytes FROM rebuilt GROUP BY path, depth
    UNION ALL
    SELECT [], 0, NULL, min(conv_id), count(*), 0 FROM heads HAVING count(*) > 0
), children AS (
    SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), whole AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), totals AS (
    SELECT v.path, sum((u.n_children = 0)::INT)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens
    FROM whole v JOIN whole u ON u.depth >= v.depth AND (v.depth = 0 OR u.path[:v.depth] = v.path) GROUP BY v.path
), last AS (
    SELECT h.conv_id, coalesce(max_by(r.path, r.depth), []) AS path FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id
), ends AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY path
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN totals t ON t.path = w.path LEFT JOIN whole p ON p.path = w.parent LEFT JOIN ends e ON e.path = w.path
"""


@query
def op12_spelling_variants(spark, sf_dir):
    return op12_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), bytes AS (  -- letters above ASCII take two bytes, the first of which is 195
    SELECT run, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, (ord(c) - 64)::BIGINT] END)) AS b
    FROM runs
), summed AS (
    SELECT run, {_CRC} AS h FROM bytes, crc_table
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM summed
), counted AS (
    SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), single AS (  -- one byte a letter, because the distance counts bytes
    SELECT word, n, length(word) AS l, translate(word, high, low) AS w FROM counted,
        (SELECT string_agg(chr(i::INT), '' ORDER BY i) AS high, string_agg(chr((i - 159)::INT), '' ORDER BY i) AS low FROM range(192, 256) r(i))
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM single a JOIN single b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND levenshtein(a.w, b.w) = 1
), best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, w := other)) AS top FROM near GROUP BY word
), forms AS (
    SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * n THEN top.w END AS form, CASE WHEN -top.m >= 5 * n THEN -top.m END AS form_n
    FROM counted c LEFT JOIN best b ON b.word = c.word
), chain AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


@query
def op13_topk_search(spark, sf_dir):
    return op13_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op13_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
