"""The queries of this subpackage and, where SQL can express them, what DuckDB has to return for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontaminate import op8_decontamination
from lodestone.llm.embedding_dedup import op9_embedding_dedup
from lodestone.llm.language_id import op7_language_id
from lodestone.llm.line_dedup import op5_line_dedup
from lodestone.llm.minhash_dedup import op2_minhash_dedup
from lodestone.llm.packing import op6_packing
from lodestone.llm.quality import op4_quality
from lodestone.llm.secrets import op3_secret_scan
from lodestone.llm.suffix_dedup import op1_suffix_dedup
from lodestone.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_minhash_dedup, op3_secret_scan, op4_quality, op5_line_dedup, op6_packing, op7_language_id,
        op8_decontamination, op9_embedding_dedup, op10_toxicity,
    )
}

SQL: dict[str, str] = {
    "op8_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS p
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN win USING (n, p)),
places AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id IS NULL OR vec_id = component_id AS kept FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
""",
}
