"""DuckDB twins of the opN_ queries that SQL can express."""

_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_KEY = f"translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_line_dedup": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM t),
k AS (SELECT doc_id, line, i, {_KEY} AS key FROM l),
common AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.i, (c.key IS NOT NULL AND k.doc_id <> c.last_doc) AS gone FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op5_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
h AS (SELECT source, tokens, tokens / sum(tokens) OVER ()::DOUBLE AS share FROM s),
x AS (SELECT max(share) AS top, min(share) AS low FROM h),
tau AS (SELECT top, CASE WHEN top / low <= 2 THEN 0.0 ELSE 1 - ln(2.0) / ln(top / low) END AS tau FROM x),
e AS (SELECT source, tokens, pow(top / share, 1 - tau) AS epochs, pow(share, tau) / sum(pow(share, tau)) OVER () AS weight FROM h, tau),
p AS (SELECT *, floor(epochs)::BIGINT AS n_full, floor((epochs - floor(epochs)) * tokens + 1e-6)::BIGINT AS rest FROM e),
r AS (SELECT d.doc_id, d.source, d.n_tokens, p.tokens, p.epochs, p.weight, p.n_full, p.rest,
             unnest(range(0, p.n_full + (p.rest > 0)::INT)) AS epoch FROM d JOIN p USING (source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('17|' || epoch || '|' || doc_id), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM r)
SELECT doc_id, source, n_tokens, epoch, tokens_before, round(epochs, 6) AS epochs, round(weight, 9) AS weight,
       round((epoch * tokens + tokens_before) / (n_full * tokens + rest)::DOUBLE, 9) AS position
FROM c WHERE epoch < n_full OR tokens_before < rest""",
    "op10_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM q JOIN v ON v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
