"""The registered queries over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import table
from linkloom.llm.decontaminate import contaminated
from linkloom.llm.kmeans import clustered
from linkloom.llm.lm import lm_scores
from linkloom.llm.merkle import manifest
from linkloom.llm.mixing import mixture
from linkloom.llm.neardup import near_duplicates
from linkloom.llm.pii import from_session, pii_report
from linkloom.llm.quality import quality
from linkloom.llm.secret_scan import secrets
from linkloom.llm.simhash import simhash_groups
from linkloom.llm.substrings import substring_dedup
from linkloom.llm.toxicity import toxicity
from linkloom.llm.warc import archive_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"), from_session(spark, make=True))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "distrusted"
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_substring_dedup, op3_pii, op4_warc, op5_mixture, op6_secret_links, op7_host_quality, op8_decontaminate, op9_lm_score, op10_jaccard_join,
        op11_merkle_manifest, op12_clusters, op13_simhash,
    )
    return {f.__name__: f for f in every}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _merkle(documents: int = 6, sources: int = 4) -> str:
    """SQL for trees of at most 16 to the given powers of leaves; k is the source, null first."""
    out = [
        "t AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)",
        f"d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 'x' || source END AS k, {_LEAF('text')} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {_LEAF('low')} ELSE {_LEAF('text')} END AS claimed FROM t)",
        "e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
        "a0 AS (SELECT k, i, leaf AS h, n FROM e)",
    ]

    def tree(name: str, levels: int) -> None:
        for j in range(levels):
            w = "OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"{name}s{j} AS (SELECT k, i, n, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j})")
            out.append(f"{name}{j + 1} AS (SELECT k, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{j} GROUP BY k, i // 16)")

    tree("a", documents)
    out.append(f"b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n, k AS source FROM a{documents})")
    tree("b", sources)
    out.append("f0 AS (SELECT doc_id, e.k, e.i, leaf, claimed AS f, '' AS p, b0.h AS subroot, b0.i AS rank FROM e JOIN b0 ON b0.source = e.k)")
    for j in range(documents + sources):
        at, k, i, power = (f"as{j}", "g.k", "g.i", j) if j < documents else (f"bs{j - documents}", "''", "g.rank", j - documents)
        out.append(f"f{j + 1} AS (SELECT doc_id, g.k, g.i, leaf, CASE WHEN s.n > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, p || s.l || s.r AS p, subroot, rank FROM f{j} AS g JOIN {at} AS s ON s.k = {k} AND s.i = {i} // {16**power})")
    last = f"f{documents + sources}"
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, z.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = z.h AS verified FROM {last}, b{sources} AS z"


def _clusters(rounds: int = 10) -> str:
    """SQL for the rounds; vectors and centroids with a row for each component."""
    out = [
        "e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM e)",
        "s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e ORDER BY c LIMIT 8)",
        "c0 AS MATERIALIZED (SELECT c, j, x FROM s JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{r} AS k USING (j) GROUP BY vec_id, c) GROUP BY vec_id)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM a{r} JOIN v USING (vec_id) GROUP BY c, j)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c, j, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c, j))")
    out.append(f"z AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS name FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(out)} SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, name AS centroid_sha256 FROM a{rounds} JOIN z USING (c)"


SQL = {
    "op11_merkle_manifest": _merkle(),
    "op12_clusters": _clusters(),
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_warc": """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first_id != page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id != page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op7_host_quality": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY 1),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM lines GROUP BY 1),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
t AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars < 2 * n_words OR word_chars > 30 * n_words AS odd,
  greatest(100 * n_symbols - 30 * n_words, 100 * n_dup_lines - 30 * n_lines, 100 * n_upper - 60 * word_chars) > 0 AS soft,
  greatest(200 * n_symbols - 30 * n_words, 200 * n_dup_lines - 30 * n_lines, 200 * n_upper - 60 * word_chars) > 0 AS strict FROM m),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR soft OR odd) AS f FROM t GROUP BY 1),
p AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS sq FROM h),
k AS (SELECT m, least(1000, greatest(10, m * (1 - m) / greatest(sq - m * m, 1e-9) - 1)) AS k FROM p),
v AS (SELECT source, (f + m * k) / (n + k) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT odd AND NOT (CASE WHEN host_rate >= 0.3 THEN strict ELSE soft END) AS kept, host_rate, host_rate >= 0.3 AS distrusted
FROM t JOIN v ON t.source IS NOT DISTINCT FROM v.source""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1),
r AS (SELECT k, min(doc_id) AS a, count(*) AS n_copies, min(n) AS n FROM z GROUP BY 1),
rs AS (SELECT a, n, g FROM r JOIN s ON s.doc_id = r.a),
l AS (SELECT x.a AS a, y.a AS b FROM rs AS x JOIN rs AS y ON x.g = y.g AND x.a != y.a GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
c(a, b) AS (SELECT a, a FROM r UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
cl AS (SELECT a, min(b) AS class_id FROM c GROUP BY 1),
nl AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(nl.n, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN r ON r.k = z.k LEFT JOIN cl ON cl.a = r.a LEFT JOIN nl ON nl.a = r.a""",
}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in SQL.items()}
