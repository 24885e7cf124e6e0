"""Check SQL of the queries that SQL can express, for DuckDB."""

ORACLES = {
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op10_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM s
        ), l AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
        ), b AS (
            SELECT source, source_size, least(weight * max(level) OVER (), most) AS target FROM l
        ), k AS (
            SELECT *, ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':7')), 1, 15))::BIGINT AS key FROM d
        ), p AS (
            SELECT k.doc_id, k.source, k.size, b.source_size, b.target, CAST(floor(b.target) AS BIGINT) AS budget,
                CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
            FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
        ), e AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
        )
        SELECT doc_id, source, size, source_size, target,
            CAST(epochs * size + least(size, greatest(budget - epochs * source_size - earlier, 0)) AS BIGINT) AS taken
        FROM e
    """,
    "op11_nra_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), s AS (
            SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d
        ), q AS (
            SELECT item_id, term, count(*) AS repeats
            FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            )
            GROUP BY ALL
        ), p AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
        ), r AS (
            SELECT item_id, doc_id,
                CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term), s
            GROUP BY ALL
        ), k AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM r WHERE score > 0
        )
        SELECT * FROM k WHERE rank <= 20
    """,
    "op13_chunk_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        a AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (
            SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS BIGINT) AS p
            FROM a WINDOW s AS (PARTITION BY lang, source)
        ), q AS (
            SELECT lang, term, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER l + 5 * count(*) OVER l) AS BIGINT) AS q
            FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL) WINDOW l AS (PARTITION BY lang)
        ), f AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ), u AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
}
