"""One query for each corpus operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, conversation_trie, curriculum_mix, divergence_rules, entropy_secrets, exact_merge, group_packing, html_blocks, phrase_streams, quality_classifier, simhash_tiles, suffix_repeats, url_logistic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_arc_to_warc(spark, sf_dir):
    return (arc_to_warc.archive_pages_once(_table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op3_html_blocks(spark, sf_dir):
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op4_exact_merge(spark, sf_dir):
    return exact_merge.exact_groups(_table(spark, sf_dir, "documents"))


def op5_simhash_tiles(spark, sf_dir):
    return simhash_tiles.near_groups(_table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark, sf_dir):
    return divergence_rules.rule_verdicts(_table(spark, sf_dir, "documents"))


def op7_group_packing(spark, sf_dir):
    return group_packing.pack(_table(spark, sf_dir, "documents"))


def op8_entropy_secrets(spark, sf_dir):
    return entropy_secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_url_logistic(spark, sf_dir):
    model = url_logistic.fit_urls(url_logistic.labelled_urls(spark))
    return url_logistic.judge_urls(_table(spark, sf_dir, "pages"), model)


def op10_curriculum_mix(spark, sf_dir):
    return (curriculum_mix.mix(_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "position"))


def op11_suffix_repeats(spark, sf_dir):
    return (suffix_repeats.drop_repeats(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_phrase_streams(spark, sf_dir):
    return phrase_streams.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_arc_to_warc, op3_html_blocks, op4_exact_merge, op5_simhash_tiles, op6_divergence_rules,
                                   op7_group_packing, op8_entropy_secrets, op9_url_logistic, op10_curriculum_mix, op11_suffix_repeats, op12_conversation_trie, op13_phrase_streams)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BIT = " + ".join(f"substr(bits, i * 5 + {k + 1}, 1)::int * {16 >> k}" for k in range(5))
_FILL = "ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN"
_ROOT = "least({t1}, {t0} + 2 * ({rest}) / ({w} + sqrt(greatest(0, {w} * {w} + {slope} * 2 * ({rest})))))"

ORACLES = {
    "op2_arc_to_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
             b AS (SELECT page_id, octet_length(encode(payload))::bigint AS payload_bytes, unhex(h)::bit::varchar AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_BIT} + 1)::bigint, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op4_exact_merge": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op10_curriculum_mix": rf"""
        WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS k,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
             s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
             w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place, source_size * 3 AS cap FROM s),
             v AS (SELECT *, (place + 1)::double AS weight FROM w),
             f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth,
                          ((sum(source_size) OVER ())::double - coalesce(sum(cap) OVER ({_FILL} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
                          / sum(weight) OVER ({_FILL} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
             t AS (SELECT source, source_size, place, CASE WHEN cap <= level * weight THEN cap::double
                          ELSE (SELECT level FROM f WHERE cap > level * weight ORDER BY nth LIMIT 1) * weight END AS target FROM f),
             r AS (SELECT doc_id, size, source_size, target, place, round(target)::bigint AS demand,
                          (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::bigint AS start
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             q AS (SELECT *, demand // greatest(source_size, 1) AS copies, start / greatest(demand, 1) AS share FROM r),
             u AS (SELECT *, (copies * size + greatest(0, least(size, demand - copies * source_size - start)))::bigint AS taken FROM q)
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken = 0 THEN NULL
                    WHEN share <= 0 THEN 0
                    WHEN place = 0 THEN {_ROOT.format(t0=0, t1=1, w=1.5, slope=-1, rest="share")}
                    WHEN place = 1 THEN {_ROOT.format(t0=0, t1=1, w=1, slope=0, rest="share")}
                    WHEN share * 0.9375 <= 0.3125 THEN {_ROOT.format(t0=0, t1=0.5, w=0.5, slope=0.5, rest="share * 0.9375")}
                    ELSE {_ROOT.format(t0=0.5, t1=1, w=0.75, slope=2, rest="share * 0.9375 - 0.3125")} END::double AS position
        FROM u""",
    "op11_suffix_repeats": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS x FROM documents),
             c AS (SELECT r, o, x, unnest(range(0, (length(x) // 2 + 950) // 1000)) * 1000 AS base FROM d),
             y AS (SELECT r, o, base, substr(x, 2 * base + 1, 2098) AS y FROM c),
             i AS (SELECT r, o, base, y, unnest(range(0, least(1000, length(y) // 2 - 49))) AS i FROM y),
             w AS (SELECT r, o, base + i AS p, substr(y, 2 * i + 1, 100) AS s FROM i),
             f AS (SELECT s, min(o) AS first FROM w GROUP BY s HAVING min(o) < max(o)),
             t AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM w JOIN f USING (s) WHERE first < o),
             g AS (SELECT r, p, count(*) FILTER (WHERE gap IS NULL OR gap > 50) OVER (PARTITION BY r ORDER BY p) AS nth FROM t),
             u AS (SELECT r, nth, min(p) AS s, max(p) + 50 AS e FROM g GROUP BY r, nth),
             k AS (SELECT d.r, u.nth, substr(x, 2 * lag(e, 1, 0) OVER (PARTITION BY d.r ORDER BY u.nth) + 1,
                                             2 * (s - lag(e, 1, 0) OVER (PARTITION BY d.r ORDER BY u.nth))) AS part FROM u JOIN d USING (r)),
             a AS (SELECT r, string_agg(part, '' ORDER BY nth) AS kept FROM k GROUP BY r),
             b AS (SELECT r, sum(e - s) AS removed, count(*) AS spans, max(e) AS last FROM u GROUP BY r)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)""",
    "op12_conversation_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                          xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
                              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                  lambda u, v: xor(u >> 1, CASE WHEN u % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
                   FROM (SELECT DISTINCT conv_id FROM t)),
             b AS (SELECT c.conv_id, t.nth AS d, r, x FROM c JOIN t ON t.conv_id = c.base AND t.nth <= c.h),
             k AS (SELECT c.conv_id, h, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.nth <= c.h) AS used FROM c),
             rb AS (SELECT * FROM b UNION ALL SELECT k.conv_id, used + nth - h, r, x FROM k JOIN t ON t.conv_id = k.conv_id AND nth > h),
             p AS (SELECT conv_id, d, length(x) AS len,
                          md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM rb
                   UNION ALL SELECT conv_id, 0, 0, '' FROM c),
             q AS (SELECT *, lag(key) OVER w AS parent, max(d) OVER (PARTITION BY conv_id) AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
             n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len, any_value(parent) AS parent,
                          string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last = d) AS ends FROM q GROUP BY d, key),
             kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
             m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, key)),
             s AS (SELECT p.d, p.key, sum((m.n_convs - 1) * m.len) AS saved, count(*) FILTER (WHERE m.n_children = 0) AS leaves
                   FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.key)
        SELECT m.conv_id, m.d::bigint AS depth, up.conv_id AS parent_conv_id, m.n_convs::bigint AS n_convs, m.n_children::bigint AS n_children,
               s.leaves::bigint AS n_leaves, s.saved::bigint AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
        FROM m JOIN s USING (d, key) LEFT JOIN n AS up ON up.d = m.d - 1 AND up.key = m.parent""",
    "op13_phrase_streams": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
             g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase
                   FROM w, (VALUES (1), (2), (3)) AS o(n) WHERE len(w) >= n),
             f AS (SELECT lang, n, phrase, count(*)::hugeint AS c FROM g GROUP BY ALL),
             t AS (SELECT lang, sum(c)::bigint AS total FROM f WHERE n = 1 GROUP BY lang),
             c AS (SELECT lang, n, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND c >= 10),
             h AS (SELECT lang, n, phrase, a, unnest(range(1, n)) AS k, w FROM c),
             e AS (SELECT lang, n, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : n], ' ') AS rp FROM h),
             k AS (SELECT e.lang, e.n, e.phrase, a, l.c AS l, r.c AS r, (1000000 * a * a) // (l.c * r.c) AS score, k
                   FROM e JOIN f AS l ON l.lang = e.lang AND l.phrase = lp JOIN f AS r ON r.lang = e.lang AND r.phrase = rp),
             b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             o AS (SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a AS longer FROM c WHERE n = 3),
             m AS (SELECT lang, phrase, max(longer) AS longer FROM o GROUP BY ALL),
             s AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
                   FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase AND b.n = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT s.lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, total AS n, score::bigint AS score
        FROM s JOIN t ON t.lang = s.lang WHERE rank <= 2000""",
}
