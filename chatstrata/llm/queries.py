"""The queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstrata.llm import (
    block_naming,
    centroids,
    collocations,
    decontaminate,
    kd_sharding,
    language_id,
    main_text,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    warc_zip,
)
from chatstrata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = block_naming.exact_groups(table(spark, sf_dir, "documents"))
    return groups.withColumnRenamed("digest", "text_sha256")


ORACLES["op10_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""


@query
def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = language_id.train(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    classifier = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, classifier)
    predicted = (F.col("score") >= quality.ACCEPTED).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packing_ = packing.pack_documents(table(spark, sf_dir, "documents"))
    digests = packing_.pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(packing_.placement, "key").drop("key")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(spark, table(spark, sf_dir, "documents"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    # as many rows as there are centroids
    clusters = F.broadcast(found.clusters.withColumn("centroid_sha256", centroids.digest("components")).drop("components"))
    return found.rows.join(clusters, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _clustering_sql(count: int, rounds: int) -> str:
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""
d{step} AS (
  SELECT k.id, c.cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)]) AS d FROM kept k CROSS JOIN c{step} c
),
a{step} AS (SELECT id, min({{'d': d, 'cluster': cluster}}) AS best FROM d{step} GROUP BY id)""")
        if step < rounds:
            steps.append(f"""
s{step} AS (
  SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{step} JOIN kept USING (id), range(1, 65) t(i) GROUP BY ALL
),
m{step} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{step} GROUP BY cluster),
c{step + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{step} c LEFT JOIN m{step} m USING (cluster))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS cluster, v FROM kept
  QUALIFY cluster < {count}
),{",".join(steps)}
SELECT k.vec_id, best.cluster::INTEGER AS cluster, best.d::BIGINT AS distance,
  (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (id) JOIN c{rounds} c ON c.cluster = best.cluster
"""


ORACLES["op12_centroid_clustering"] = _clustering_sql(centroids.COUNT, centroids.ROUNDS)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, [w for w in regexp_split_to_array(piece, '[\x20\x09]+') if w <> ''] AS w FROM pieces),
phrases AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
  FROM words, (VALUES (1), (2), (3)) t(k)
),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 10),
sides AS MATERIALIZED (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS first_words, array_to_string(w[cut + 1:], ' ') AS rest
  FROM often, (VALUES (1), (2)) t(cut) WHERE cut < k
),
cuts AS MATERIALIZED (
  SELECT s.lang, s.phrase, s.a, s.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * s.a * s.a) // (x.f::HUGEINT * y.f) AS score
  FROM sides s JOIN often x ON x.lang = s.lang AND x.phrase = s.first_words JOIN often y ON y.lang = s.lang AND y.phrase = s.rest
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f AS a FROM often WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.longest IS NULL OR 100::HUGEINT * o.longest < 50::HUGEINT * s.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))
