"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_SHINGLES = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"""
_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9_\x{80}-\x{10FFFF}]+')"



def _product_codes(rounds: int = 4) -> str:
    """Lloyd's rounds over all pairs of parts and entries; the least distance * 256 + index names the entry and the distance."""
    out = """WITH k AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS y FROM x JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256) USING (vec_id))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS BIGINT) * 256 + e) AS m FROM x JOIN c{r} USING (p) GROUP BY vec_id, p)"""
        if r < rounds:
            out += f""",
u{r} AS (SELECT p, m % 256 AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}),
w{r} AS (SELECT p, e, list(z ORDER BY i) AS z FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS z FROM u{r} GROUP BY p, e, i) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(z, y) AS y FROM c{r} LEFT JOIN w{r} USING (p, e))"""
    return out + f""",
h AS (SELECT sha256(string_agg(array_to_string([CAST(z AS BIGINT) FOR z IN y], ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
d AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM d JOIN k USING (vec_id), h"""


ORACLES: dict[str, str] = {
    "op7_decontamination": f"""WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark), i AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM iw), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM dw)
SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS item_shingles, count(*)::DOUBLE / any_value(n) AS containment FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n)""",
    "op11_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
m AS (SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) + 4 * CAST(100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x) AS INTEGER)
  + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS m FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT array_to_string(fs, '') AS filter_order, step, fs[step] AS f, bs[step] AS b, list_sum(bs[1:step]) - bs[step] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (m & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & b > 0 AND m & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (m & b > 0 AND m & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (m = b), 0) AS unique_fails,
  coalesce(sum(good) FILTER (m & b > 0 AND m & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (m & b > 0 AND m & before = 0), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op12_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha256(x) AS payload_digest, CASE WHEN strlen(x) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(x) >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
    "op13_vector_codes": _product_codes(),
}
