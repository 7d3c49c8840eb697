"""Vectors, clusters, prototypes and retrieval."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import LANGS, centroids, pool_emb, preds, prototypes
from poolsift.operators import clustering
from poolsift.operators.metrics import retrieval
from poolsift.operators.metrics.classification import with_prediction
from poolsift.operators.nearest import nearest
from poolsift.plans import curation
from poolsift.session import run_dir
from poolsift.sources.vector_files import read_npz, write_with_vectors


def _total():
    return F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total")


def write_archives(spark, sf, files: int = 4) -> str:
    """Pool rows that have a vector, as parquet files with an archive next to each."""
    folder = run_dir(spark, "archives")
    rows = pool_emb(spark, sf).select("uid", "doc_id", "text", "lang", "label", "vec")
    write_with_vectors(rows.repartitionByRange(files, "doc_id"), folder)
    return folder


@check(
    "scan_embeddings",
    "SELECT CAST(len(vec) AS INTEGER) AS dim, round(list_sum(vec), 5) AS total, count(*) AS n FROM pool_emb GROUP BY ALL",
)
def scan_embeddings(spark, sf):
    """Archives written by tasks and read by ranges."""
    vectors = read_npz(spark, write_archives(spark, sf))
    return vectors.select(F.size("vec").alias("dim"), _total()).groupBy("dim", "total").agg(F.count(F.lit(1)).alias("n"))


@check("emb_join", "SELECT doc_id AS row_idx, uid, label, round(list_sum(vec), 5) AS total FROM pool_emb")
def emb_join(spark, sf):
    """Metadata files with the vectors at the same places of their archives."""
    rows = curation.pool_with_vectors(spark, write_archives(spark, sf), ["uid", "doc_id", "label"])
    return rows.select(F.col("doc_id").alias("row_idx"), "uid", "label", _total())


@check("emb_join_kept", "SELECT uid, round(list_sum(vec), 5) AS total FROM pool_emb WHERE lang = 'en' AND label < 5")
def emb_join_kept(spark, sf):
    """The same for the rows that a filter leaves; other vectors are never read."""
    rows = curation.pool_with_vectors(
        spark, write_archives(spark, sf), ["uid", "lang", "label"], keep=lambda df: df.where("lang = 'en' AND label < 5")
    )
    return rows.select("uid", _total())


@check("assign_centroid", "SELECT uid, centroid_id, round(score, 6) AS score FROM assigned")
def assign_centroid(spark, sf):
    placed = clustering.assign(pool_emb(spark, sf), centroids(spark, sf))
    return placed.select("uid", "centroid_id", F.round("score", 6).alias("score"))


@check("assign_centroid_blocks", "SELECT uid, centroid_id, round(score, 6) AS score FROM assigned")
def assign_centroid_blocks(spark, sf):
    """The same with the centroids in several blocks."""
    placed = nearest(pool_emb(spark, sf), centroids(spark, sf), tile_bytes=6_000)
    return placed.select("uid", "centroid_id", F.round("score", 6).alias("score"))


@check("centroid_sizes", "SELECT centroid_id, count(*) AS size FROM assigned GROUP BY centroid_id")
def centroid_sizes(spark, sf):
    return clustering.centroid_sizes(clustering.assign(pool_emb(spark, sf), centroids(spark, sf)))


@check(
    "kmeans_step",
    """
    WITH placed AS (
        SELECT uid, vec, centroid_id, row_number() OVER (PARTITION BY uid ORDER BY
            list_inner_product(vec, centroid) - list_inner_product(centroid, centroid) / 2 DESC, centroid_id) AS place
        FROM pool_emb, centroids),
    parts AS (SELECT centroid_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM placed WHERE place = 1)
    SELECT centroid_id, pos, count(*) AS n, round(avg(x), 6) AS x FROM parts GROUP BY 1, 2
    """,
)
def kmeans_step(spark, sf):
    moved = clustering.kmeans_step(pool_emb(spark, sf), centroids(spark, sf))
    parts = moved.select("centroid_id", "n", F.posexplode("centroid").alias("pos", "x"))
    return parts.select("centroid_id", F.col("pos").cast("bigint").alias("pos"), "n", F.round("x", 6).alias("x"))


def _lloyd(steps: int, k: int) -> str:
    """The steps of k-means written out one after the other, from the k points of the least hashes."""
    parts = [
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5('0:' || uid)) - 1 AS INTEGER) AS centroid_id, vec AS centroid
            FROM pool_emb QUALIFY centroid_id < {k})"""
    ]
    for i in range(steps):
        parts.append(
            f"""p{i} AS (SELECT vec, centroid_id FROM (SELECT vec, centroid_id, row_number() OVER (PARTITION BY uid ORDER BY
                list_inner_product(vec, centroid) - list_inner_product(centroid, centroid) / 2 DESC, centroid_id) AS place
                FROM pool_emb, c{i}) WHERE place = 1),
            m{i} AS (SELECT centroid_id, list(x ORDER BY pos) AS centroid FROM (SELECT centroid_id, pos, avg(x) AS x FROM (
                SELECT centroid_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM p{i}) GROUP BY ALL) GROUP BY centroid_id),
            c{i + 1} AS (SELECT c.centroid_id, coalesce(m.centroid, c.centroid) AS centroid FROM c{i} c LEFT JOIN m{i} m USING (centroid_id))"""
        )
    return f"""WITH {", ".join(parts)}
        SELECT centroid_id, pos, round(x, 5) AS x FROM (
            SELECT centroid_id, unnest(centroid) AS x, unnest(range(len(centroid))) AS pos FROM c{steps})"""


@check("kmeans_train", _lloyd(5, 8))
def kmeans_train(spark, sf):
    trained = clustering.train_kmeans(pool_emb(spark, sf), k=8, iterations=5, seed=0)
    parts = trained.select("centroid_id", F.posexplode("centroid").alias("pos", "x"))
    return parts.select("centroid_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 5).alias("x"))


@check(
    "class_prototypes",
    "SELECT label, pos, round(x, 6) AS x FROM (SELECT label, unnest(prototype) AS x, unnest(range(len(prototype))) AS pos FROM prototypes)",
)
def class_prototypes(spark, sf):
    parts = prototypes(spark, sf).select("label", F.posexplode("prototype").alias("pos", "x"))
    return parts.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@check(
    "zero_shot_predict",
    "SELECT sample_id, y_pred, round(list_max(logits), 5) AS logit FROM preds",
)
def zero_shot_predict(spark, sf):
    rows = with_prediction(preds(spark, sf))
    return rows.select("sample_id", "y_pred", F.round(F.array_max("logits"), 5).alias("logit"))


@check(
    "multi_objective_predict",
    """
    WITH means AS (
        SELECT 'label' AS objective, label AS c, pos, avg(x) AS x FROM (
            SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM pool_emb) GROUP BY ALL
        UNION ALL
        SELECT 'lang', list_position(['de', 'en', 'es', 'fr'], lang) - 1, pos, avg(x) FROM (
            SELECT lang, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM pool_emb) GROUP BY ALL),
    lists AS (SELECT objective, c, list(x ORDER BY pos) AS m FROM means GROUP BY 1, 2),
    best AS (
        SELECT doc_id, objective, c, row_number() OVER (PARTITION BY doc_id, objective
            ORDER BY list_inner_product(vec, m) / sqrt(list_inner_product(m, m)) DESC, c) AS place FROM pool_emb, lists)
    SELECT doc_id, CAST(max(CASE WHEN objective = 'label' THEN c END) AS INTEGER) AS pred_label,
        CAST(max(CASE WHEN objective = 'lang' THEN c END) AS INTEGER) AS pred_lang FROM best WHERE place = 1 GROUP BY doc_id
    """,
)
def multi_objective_predict(spark, sf):
    """Two objectives with different numbers of classes, predicted in one pass."""
    emb = pool_emb(spark, sf)
    place = (F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1).cast("int")
    by_label = emb.select(F.lit("label").alias("objective"), F.col("label").alias("class_id"), "vec")
    by_lang = emb.select(F.lit("lang").alias("objective"), place.alias("class_id"), "vec")
    learned = clustering.class_prototypes(by_label.unionAll(by_lang), ["objective", "class_id"])
    rows = clustering.predict_objectives(emb.select("doc_id", "vec"), learned)
    return rows.select("doc_id", "pred_label", "pred_lang")


RAW_RECALL = """
    SELECT count(*) AS queries, avg(CAST(ahead < 1 AS DOUBLE)) AS recall_1,
        avg(CAST(ahead < 5 AS DOUBLE)) AS recall_5, avg(CAST(ahead < 10 AS DOUBLE)) AS recall_10
    FROM (SELECT query, count(*) FILTER (score > best + 1e-9) AS ahead FROM (
        SELECT *, max(CASE WHEN hit THEN score END) OVER (PARTITION BY query) AS best FROM (
            SELECT {query} AS query, centroid_id = label * 4 + list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS hit,
                list_inner_product(vec, centroid) AS score FROM pool_emb, centroids))
        WHERE best IS NOT NULL GROUP BY query)
"""
RETRIEVAL_SQL = f"""
    SELECT queries, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10
    FROM ({RAW_RECALL})
"""


def _sides(spark, sf):
    emb = pool_emb(spark, sf)
    place = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    pictures = emb.select(F.col("doc_id").alias("id"), "vec")
    texts = centroids(spark, sf).select(F.col("centroid_id").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    pairs = emb.select(F.col("doc_id").alias("image"), (F.col("label") * 4 + place).cast("bigint").alias("text"))
    return pictures, texts, pairs


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if "recall" in c else c for c in df.columns])


@check("text_retrieval", RETRIEVAL_SQL.format(query="doc_id"))
def text_retrieval(spark, sf):
    pictures, texts, pairs = _sides(spark, sf)
    return _rounded(retrieval.retrieval_recall(pictures, texts, pairs.toDF("query_id", "candidate_id")))


@check("image_retrieval", RETRIEVAL_SQL.format(query="centroid_id"))
def image_retrieval(spark, sf):
    pictures, texts, pairs = _sides(spark, sf)
    return _rounded(retrieval.retrieval_recall(texts, pictures, pairs.toDF("candidate_id", "query_id")))


@check(
    "retrieval_recall",
    f"""
    WITH t AS ({RAW_RECALL.format(query="doc_id")}), i AS ({RAW_RECALL.format(query="centroid_id")})
    SELECT round(t.recall_1, 6) AS text_retrieval_recall_1, round(t.recall_5, 6) AS text_retrieval_recall_5,
        round(t.recall_10, 6) AS text_retrieval_recall_10, round(i.recall_1, 6) AS image_retrieval_recall_1,
        round(i.recall_5, 6) AS image_retrieval_recall_5, round(i.recall_10, 6) AS image_retrieval_recall_10,
        round((t.recall_1 + i.recall_1) / 2, 6) AS mean_recall_1 FROM t, i
    """,
)
def retrieval_recall(spark, sf):
    return _rounded(retrieval.retrieval_both_ways(*_sides(spark, sf)))
