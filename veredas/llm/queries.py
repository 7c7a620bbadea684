"""The queries op1 to op13: each operator over its whole table, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veredas.llm import centroids, decontamination, importance, jaccard, language_id, mixing, piecewise_hash, sharding, simhash, suffix_tree, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir), shards=24)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_docs(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.language_model_scores(_docs(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprints(_docs(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.grouped(_docs(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1,
    "op2_decontamination": op2,
    "op3_token_counts": op3,
    "op4_language_id": op4,
    "op5_lm_scoring": op5,
    "op6_warc": op6,
    "op7_piecewise_hash": op7,
    "op8_toxicity": op8,
    "op9_simhash": op9,
    "op10_mixing": op10,
    "op11_jaccard_join": op11,
    "op12_centroids": op12,
    "op13_importance": op13,
}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""



def _centroids_sql(rounds: int = 10, k: int = 8) -> str:
    """One table of centroids a round (k, c) and one of assignments, over the kept vectors (rid, vec_id, q)."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS k, q AS c FROM v QUALIFY k < {k})"""]
    near = """a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'k': k}}) AS m FROM (
      SELECT rid, vec_id, q, k, list_sum(list_transform(generate_series(1, 64), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS d FROM v, c{r}) GROUP BY rid)"""
    for r in range(rounds):
        steps += [near.format(r=r), f"""
s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{r} o LEFT JOIN m{r} m USING (k))"""]
    steps.append(near.format(r=rounds))
    return f"""WITH {', '.join(steps)}
SELECT vec_id, a.m.k::INTEGER AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.k))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k
"""


#: CRC-32 of a text's bytes: its table by the rule of the polynomial, and a step a byte.
_CRC_TABLE = "SELECT list(list_reduce([i] || generate_series(0, 7), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM generate_series(0, 255) g(i)"
_CRC = "xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(generate_series(0, len(x) // 2 - 1), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])))"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
starts AS (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM starts),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT k FROM grams),
places AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, lengths WHERE len(w) >= k),
found AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM places p JOIN grams g ON g.k = p.k AND g.g = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS keep FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
""",
    "op11_jaccard_join": r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
d AS MATERIALIZED (SELECT row_number() OVER () AS sid, s, min(doc_id) AS first FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT sid, len(s) AS n, unnest(s) AS t FROM d),
e AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b FROM t a JOIN t b ON a.t = b.t AND a.sid <> b.sid AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
                   GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (WITH RECURSIVE r AS (SELECT sid, sid AS at FROM d UNION SELECT r.sid, e.b FROM r JOIN e ON e.a = r.at) SELECT r.sid, min(d.first) AS component_id FROM r JOIN d ON d.sid = r.at GROUP BY r.sid)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s LEFT JOIN d USING (s) LEFT JOIN c USING (sid)
""",
    "op12_centroids": _centroids_sql(),
    "op13_importance": f"""
WITH w AS (SELECT 1 AS side, row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
           UNION ALL SELECT 2, row_number() OVER (), NULL, {_WORDS} FROM benchmark),
g AS (SELECT side, rid, unnest(w) AS g FROM w UNION ALL
      SELECT side, rid, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
t AS ({_CRC_TABLE}),
b AS (SELECT g, {_CRC} % 10000 AS b FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g)), t),
f AS (SELECT side, rid, b FROM g JOIN b USING (g)),
n AS (SELECT i AS b, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM generate_series(0, 9999) x(i) LEFT JOIN f ON f.b = i GROUP BY i),
gain AS (SELECT b, floor(1000.0::DOUBLE * ln((t + 1.0::DOUBLE) * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM n),
d AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN gain USING (b) WHERE side = 1 GROUP BY rid),
h AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(d.n, 0) AS n_features, CASE WHEN d.n > 0 THEN (total - ((total % d.n) + d.n) % d.n) // d.n ELSE 0 END AS weight,
             ('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (rid) WHERE side = 1),
s AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, n_words, row_number() OVER (ORDER BY score DESC, doc_id) AS r, n_features, weight, score FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * 25 // 100 THEN r END AS rank FROM r
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM s WHERE n_words < 20
""",
}
