"""The corpus queries and their SQL: ``QUERIES[name](spark, sf_dir)`` and ``ORACLE_SQL[name]``."""

from __future__ import annotations

from .fingerprints import OP11_SQL, op11_imatch
from .jaccard_join import op1_jaccard_join
from .language import op10_language_id
from .mixing import OP8_SQL, op8_source_mix
from .packing import OP2_SQL, op2_packing
from .pii import op7_pii
from .pivot_index import OP6_SQL, op6_pivot_dedup
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .secrets import op3_secret_scan
from .substring_dedup import op4_substring_dedup
from .token_counts import op5_token_counts
from .vp_tree import OP9_SQL, op9_vp_tree_search
from .whitening import op13_whitening

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_pivot_dedup": op6_pivot_dedup,
    "op7_pii": op7_pii,
    "op8_source_mix": op8_source_mix,
    "op9_vp_tree_search": op9_vp_tree_search,
    "op10_language_id": op10_language_id,
    "op11_imatch": op11_imatch,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op2_packing": OP2_SQL,
    "op6_pivot_dedup": OP6_SQL,
    "op9_vp_tree_search": OP9_SQL,
    "op8_source_mix": OP8_SQL,
    "op11_imatch": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op1_jaccard_join": """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM t),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM n JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)
""",
}
