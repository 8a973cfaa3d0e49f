"""Queries of the operators in this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from lamina.llm import boilerplate, garbled, lookalike, names, neardup, packing, pii, sentences, tokens


def queries():
    return {
        "p1_found": garbled.p1_found,
        "p1_restored": garbled.p1_restored,
        "p3_found": lookalike.p3_found,
        "p3_normalized": lookalike.p3_normalized,
        "p4_found": neardup.p4_found,
        "p4_groups": neardup.p4_groups,
        "p5_found": names.p5_found,
        "p6_found": sentences.p6_found,
        "p6_sentences": sentences.p6_sentences,
        "p7_found": boilerplate.p7_found,
        "p7_main_text": boilerplate.p7_main_text,
        "p8_ids": tokens.p8_ids,
        "p8_decoded": tokens.p8_decoded,
        "p9_packing": packing.p9_packing,
        "p9_fill": packing.p9_fill,
        "p9_kept": packing.p9_kept,
        "p10_found": pii.p10_found,
        "p10_redacted": pii.p10_redacted,
    }


#: White space as Python splits at it.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_SHINGLES = f"""
w AS (SELECT article_id AS id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || text), '{_SPACE}'), lambda x: x <> '') AS w FROM articles WHERE regexp_matches(text, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]')),
s AS (SELECT id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
alike AS (SELECT a, b, k = n AND k = m AS same FROM p WHERE k >= 0.6 * (n + m - k))"""


def oracle_sql():
    """Exact set overlap for the articles alike; what encoding and packing must keep."""
    return {
        "p4_found": f"WITH {_SHINGLES} SELECT a AS article_a, b AS article_b FROM alike",
        "p4_groups": f"""WITH {_SHINGLES}, c AS (SELECT id, least(id, coalesce(min(a), id)) AS rep FROM s LEFT JOIN (SELECT * FROM alike WHERE same) ON b = id GROUP BY id),
l AS (SELECT x.rep AS one, y.rep AS other FROM alike JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.rep <> y.rep), n AS (SELECT one AS rep, other FROM l UNION SELECT other, one FROM l)
SELECT c.id AS article_id, c.rep AS class_id, count(n.other) AS links FROM c LEFT JOIN n USING (rep) GROUP BY 1, 2""",
        "p8_decoded": "SELECT doc_id, text FROM documents",
        "p9_kept": "SELECT spec_id, count(*) AS documents, 0 AS overfull, 0 AS split_in_vain, 0 AS lost FROM documents, pack_specs GROUP BY 1",
    }
