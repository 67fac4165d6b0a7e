"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .htmltext import op9_html
from .langid import op10_langid
from .mixing import op4_mixing
from .packing import op1_packing
from .pii import op2_pii
from .ppm import op3_ppm
from .simhash import op5_simhash
from .topk import op8_topk
from .urlgraph import op7_urls
from .vectorlinks import op6_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_ppm": op3_ppm,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_vectors": op6_vectors,
    "op7_urls": op7_urls,
    "op8_topk": op8_topk,
    "op9_html": op9_html,
    "op10_langid": op10_langid,
}
_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: For tables whose vectors have one length.
ORACLES: dict[str, str] = {
    "op6_vectors": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u), c AS (SELECT u, min(w) AS c FROM r GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id""",
    "op8_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_GOOD} AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
}
