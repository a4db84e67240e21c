"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from dyadflow.llm import bags, exact, language, lengths, negatives, packing, passages, periods, phrases, private, quality, suffixes, urls
from dyadflow.llm.common import table


VOCABULARY = "word_bpe_49k.json"


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_token_counts(spark, sf_dir):
    return lengths.context_limits(lengths.length_histogram(table(spark, sf_dir, "documents"), VOCABULARY))


def op3_decontamination(spark, sf_dir):
    return phrases.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repeated_passages(spark, sf_dir):
    return passages.remove_recurring(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return bags.near_classes(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffixes.remove_earlier(table(spark, sf_dir, "documents"))


def op10_url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("mined_rule")


def op11_hard_negatives(spark, sf_dir):
    return negatives.contract_negatives(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    return periods.digests(periods.periodic_runs(periods.with_planted_tails(table(spark, sf_dir, "documents"))))


def op13_private_data(spark, sf_dir):
    return private.digests(private.find_private(table(spark, sf_dir, "documents")))


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_repeated_passages": op5_repeated_passages,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_near_dedup": op7_near_dedup,
        "op8_language": op8_language,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_url_rules": op10_url_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_private_data": op13_private_data,
    }


def oracle_sql():
    return {
        "op3_decontamination": """
            WITH d AS (
                SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
            b AS (
                SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
            win AS (
                SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
                FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
            lens AS (SELECT DISTINCT n FROM win),
            grams AS (
                SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
            occ AS (SELECT doc_id, n, i, item_id FROM grams JOIN win USING (n, p)),
            hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM occ, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
            it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id),
            pos AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM d),
            places AS (SELECT DISTINCT p, n, unnest(string_split(p, ' ')) AS t, unnest(range(0, n)) AS o FROM win),
            freq AS (SELECT t, count(*) AS f FROM pos WHERE t IN (SELECT t FROM places) GROUP BY t),
            ranked AS (SELECT p, n, t, o, row_number() OVER (PARTITION BY p ORDER BY f, t, o) AS r, min(coalesce(f, 0)) OVER (PARTITION BY p) AS least FROM places LEFT JOIN freq USING (t)),
            spot AS (SELECT doc_id, p, n, r, i - o AS s FROM ranked JOIN pos USING (t) WHERE r <= 2 AND least > 0),
            near AS (SELECT a.doc_id, count(DISTINCT a.p) AS n_near FROM spot a LEFT JOIN spot b ON a.doc_id = b.doc_id AND a.p = b.p AND b.r = 2 AND abs(a.s - b.s) <= 2
                     WHERE a.r = 1 AND (a.n = 1 OR b.p IS NOT NULL) GROUP BY a.doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
            FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)""",
        "op6_exact_dedup": """
            WITH d AS (
                SELECT doc_id, coalesce(length(text), 0) AS points,
                       sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
                FROM documents)
            SELECT doc_id,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
                   text_sha256
            FROM d""",
        "op11_hard_negatives": """
            WITH e AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                       list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT a.vec_id AS aid, b.vec_id AS bid, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
                FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT aid, bid AS pid, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, bid) <= 5),
            n AS (
                SELECT aid, pid, ps, bid AS nid, score AS ns, row_number() OVER (PARTITION BY aid, pid ORDER BY score DESC, bid) AS rank
                FROM p JOIN s USING (aid) WHERE NOT same AND 80 * ps <= 100 * score AND score <= ps)
            SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score
            FROM n WHERE rank <= 5""",
    }
