"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporline.llm import bpe_codec, exact_dedup, line_dedup, maxscore, mixing, pii, quality, simhash, token_counts, url_filter
from vaporline.llm.common import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, is_query="id % 50 = 0")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.scratch_index(spark)
    found = exact_dedup.classes(docs, index)
    index.drop()
    return found


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", "fingerprint", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, budget=512)


URL_RULES = [
    url_filter.HostRule("net", "/", "block"),
    url_filter.HostRule("example.net", "/en/", "allow"),
    url_filter.HostRule("example.com", "/de/", "block"),
    url_filter.HostRule("org", "/fr/", "allow"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(bpe_codec.encode(docs))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    """The digests of encoded documents' ids and of the texts that these decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = encoded.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), "ids")
    return bpe_codec.decode(rows).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs)
    base = pii.of_kinds(F.col("spans"), pii.BASE)
    return found.select(
        "doc_id",
        *[F.size(pii.of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM named
), summed AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0) AS DOUBLE) AS remaining,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS BIGINT) AS open,
    row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST) AS n
  FROM weighed
  WINDOW below AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT remaining, open FROM summed WHERE NOT (cap * open <= remaining * weight) ORDER BY n LIMIT 1
), targets AS (
  SELECT s.source, s.source_size,
    CASE WHEN NOT (s.cap * s.open <= s.remaining * s.weight) THEN l.remaining * s.weight / l.open ELSE CAST(s.cap AS DOUBLE) END AS target
  FROM summed s LEFT JOIN level l ON true
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || left(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest), 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS line
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x FROM documents)
), w AS (
  SELECT *, CAST(len(regexp_extract_all(line, '[^\x20]+')) AS BIGINT) AS words FROM l
), common AS (
  SELECT a.doc_id, b.doc_id AS earlier, a.i, a.i - b.i AS diagonal, a.words
  FROM w a JOIN w b ON a.line = b.line AND b.doc_id < a.doc_id
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, earlier, diagonal ORDER BY i) AS island FROM common
), blocks AS (
  SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id, earlier, diagonal, island) AS n FROM islands
), gone AS (
  SELECT DISTINCT doc_id, i FROM blocks WHERE n >= 10
), removed AS (
  SELECT g.doc_id, CAST(count(*) AS BIGINT) AS n_removed, CAST(sum(words) AS BIGINT) AS words_removed, string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i) AS removed
  FROM gone g JOIN w ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY g.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  coalesce(n_removed, 0) AS n_removed, coalesce(words_removed, 0) AS words_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.n <> c.n
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS i FROM d
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size, i = 1 AS kept, text_sha256
FROM n
"""


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_line_dedup": op2_line_dedup,
        "op3_maxscore": op3_maxscore,
        "op4_quality": op4_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_simhash": op6_simhash,
        "op7_token_counts": op7_token_counts,
        "op8_url_filter": op8_url_filter,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_maxscore": OP3_SQL, "op5_exact_dedup": OP5_SQL}
