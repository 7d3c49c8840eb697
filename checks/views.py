"""The driver tables seen as pool, subset, predictions and so on; in Spark and in SQL.

All rows of the tables take part; columns the tables lack (scores, sizes) are worked out
from the ones they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import sql_view
from poolsift.functions.text import words
from poolsift.operators.clustering import class_prototypes
from poolsift.operators.nearest import scores_against

# Blanks as a character class for DuckDB's regular expressions.
SQL_BLANKS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{SQL_BLANKS}'), lambda w: w <> '')"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fraction(hex_digits):
    return F.conv(hex_digits, 16, 10).cast("double") / F.lit(4294967296.0)


def doc_uid(column: str = "doc_id"):
    return F.md5(F.col(column).cast("string"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    uid = F.col("uid")
    chars = F.col("n_chars")
    return (
        table(spark, sf, "documents")
        .withColumn("uid", doc_uid())
        .select(
            "uid",
            "doc_id",
            "text",
            "lang",
            "source",
            "n_chars",
            F.when(chars >= 20, 64 + (chars * 37) % 1000).cast("int").alias("original_width"),
            (64 + (chars * 53) % 800).cast("int").alias("original_height"),
            F.when(chars >= 10, _fraction(F.substring(uid, 17, 8))).alias("clip_b32_similarity_score"),
            F.when(chars >= 10, _fraction(F.substring(uid, 25, 8))).alias("clip_l14_similarity_score"),
        )
    )


sql_view(
    "pool",
    """
    SELECT md5(CAST(doc_id AS VARCHAR)) AS uid, doc_id, text, lang, source, n_chars,
        CAST(CASE WHEN n_chars >= 20 THEN 64 + (n_chars * 37) % 1000 END AS INTEGER) AS original_width,
        CAST(64 + (n_chars * 53) % 800 AS INTEGER) AS original_height,
        CASE WHEN n_chars >= 10 THEN CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 17, 8) AS UBIGINT) AS DOUBLE)
            / 4294967296::DOUBLE END AS clip_b32_similarity_score,
        CASE WHEN n_chars >= 10 THEN CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 25, 8) AS UBIGINT) AS DOUBLE)
            / 4294967296::DOUBLE END AS clip_l14_similarity_score
    FROM documents
    """,
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(doc_uid().alias("uid"), "doc_id", "quality", "toxic")


sql_view(
    "labelled", "SELECT md5(CAST(doc_id AS VARCHAR)) AS uid, doc_id, quality, toxic FROM labels"
)


def foreign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids no pool sample has."""
    return table(spark, sf, "benchmark").select(
        F.md5(F.concat(F.lit("item-"), F.col("item_id").cast("string"))).alias("uid")
    )


sql_view("foreign_ids", "SELECT md5('item-' || CAST(item_id AS VARCHAR)) AS uid FROM benchmark")


def subset(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled samples, good ones twice, and ids the pool lacks."""
    rows = labelled(spark, sf)
    return (
        rows.select("uid")
        .unionAll(rows.filter("quality = 1").select("uid"))
        .unionAll(foreign_ids(spark, sf))
    )


sql_view(
    "subset",
    """
    SELECT uid FROM labelled UNION ALL SELECT uid FROM labelled WHERE quality = 1
    UNION ALL SELECT uid FROM foreign_ids
    """,
)


def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of downloaded shards: labelled samples and samples that have no metadata."""
    known = labelled(spark, sf).select("uid", F.concat(F.lit("shard-"), "quality").alias("shard"))
    return known.unionAll(foreign_ids(spark, sf).withColumn("shard", F.lit("shard-x")))


sql_view(
    "shard_rows",
    """
    SELECT uid, 'shard-' || CAST(quality AS VARCHAR) AS shard FROM labelled
    UNION ALL SELECT uid, 'shard-x' AS shard FROM foreign_ids
    """,
)


def pool_emb(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label"
    )
    return pool(spark, sf).join(vectors, "doc_id")


sql_view(
    "pool_emb",
    "SELECT p.*, e.embedding::DOUBLE[] AS vec, e.label FROM pool p JOIN embeddings e ON p.doc_id = e.vec_id",
)

LANGS = ("de", "en", "es", "fr")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per (label, language)."""
    place = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    return (
        pool_emb(spark, sf)
        .select((F.col("label") * 4 + place).cast("int").alias("centroid_id"), F.posexplode("vec").alias("pos", "x"))
        .groupBy("centroid_id", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("centroid_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select("centroid_id", F.col("parts.x").alias("centroid"))
    )


sql_view(
    "centroid_parts",
    """
    SELECT CAST(label * 4 + list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS centroid_id, pos, avg(x) AS x
    FROM (SELECT label, lang, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM pool_emb) GROUP BY 1, 2
    """,
)
sql_view(
    "centroids",
    "SELECT centroid_id, list(x ORDER BY pos) AS centroid FROM centroid_parts GROUP BY centroid_id",
)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the samples labelled toxic, as the wanted region."""
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return (
        table(spark, sf, "embeddings")
        .join(toxic, "vec_id", "left_semi")
        .select("vec_id", F.col("embedding").alias("vec"))
    )


sql_view(
    "targets",
    """
    SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    """,
)
sql_view(
    "assigned",
    """
    SELECT uid, centroid_id, score FROM (
        SELECT uid, centroid_id, list_inner_product(vec, centroid) AS score,
            row_number() OVER (PARTITION BY uid ORDER BY list_inner_product(vec, centroid) DESC, centroid_id) AS place
        FROM pool_emb, centroids) WHERE place = 1
    """,
)
sql_view(
    "target_centroids",
    """
    SELECT DISTINCT centroid_id FROM (
        SELECT centroid_id, row_number() OVER (
            PARTITION BY vec_id ORDER BY list_inner_product(vec, centroid) DESC, centroid_id) AS place
        FROM targets, centroids) WHERE place = 1
    """,
)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark items; the first sense of a word is the first item that has it."""
    return (
        table(spark, sf, "benchmark")
        .select(F.explode(words(F.col("text"))).alias("word"), "item_id")
        .groupBy("word")
        .agg(F.min("item_id").cast("int").alias("synset_offset"))
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Items that count as entities: the ones with short texts."""
    return (
        table(spark, sf, "benchmark")
        .filter(F.length("text") < 200)
        .select(F.col("item_id").cast("int").alias("synset_offset"))
    )


sql_view(
    "lexicon",
    f"""
    SELECT word, CAST(min(item_id) AS INTEGER) AS synset_offset
    FROM (SELECT item_id, unnest({sql_words("text")}) AS word FROM benchmark) GROUP BY word
    """,
)
sql_view("entities", "SELECT CAST(item_id AS INTEGER) AS synset_offset FROM benchmark WHERE length(text) < 200")


def shards(spark: SparkSession, sf: str) -> DataFrame:
    """One shard per document source."""
    return (
        table(spark, sf, "documents")
        .groupBy(F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("shard_id"))
        .agg(F.count(F.lit(1)).alias("size"))
    )


sql_view(
    "shards",
    "SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS shard_id, count(*) AS size FROM documents GROUP BY 1",
)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """As many boxes as a labelled sample has flags; none is an empty list."""
    box = lambda i: F.array(
        (F.col("doc_id") % 100) / F.lit(100.0), F.lit(0.25), F.lit(0.5), i.cast("double")
    )
    count = F.col("quality") + F.col("toxic")
    some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), box)
    return labelled(spark, sf).select("uid", F.slice(some, F.lit(1), count).alias("face_bboxes"))


sql_view(
    "boxes",
    """
    SELECT uid, list_transform(range(1, quality + toxic + 1),
        lambda i: [(doc_id % 100) / 100::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, CAST(i AS DOUBLE)]) AS face_bboxes
    FROM labelled
    """,
)


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vec"))
    return class_prototypes(rows, ["label"])


sql_view(
    "prototype_means",
    """
    SELECT label, list(x ORDER BY pos) AS m FROM (
        SELECT label, pos, avg(x) AS x FROM (
            SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
        GROUP BY 1, 2) GROUP BY label
    """,
)
sql_view(
    "prototypes",
    "SELECT label, list_transform(m, lambda v: v / sqrt(list_inner_product(m, m))) AS prototype FROM prototype_means",
)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-shot logits of every embedding, with the sample's fields as metadata."""
    rows = pool_emb(spark, sf).select(
        F.col("doc_id").alias("sample_id"),
        F.col("label").alias("y_true"),
        F.concat(F.lit("set-"), "lang").alias("dataset"),
        F.when(F.col("lang") == "es", "Other").otherwise(F.col("lang")).alias("region"),
        (2000 + F.col("n_chars") % 5).cast("int").alias("year"),
        "source",
        "n_chars",
        "vec",
    )
    return scores_against(rows, prototypes(spark, sf), "label", "prototype", scale=100.0)


sql_view(
    "preds",
    """
    SELECT e.doc_id AS sample_id, any_value(e.label) AS y_true, any_value('set-' || lang) AS dataset,
        any_value(CASE WHEN lang = 'es' THEN 'Other' ELSE lang END) AS region,
        any_value(CAST(2000 + n_chars % 5 AS INTEGER)) AS year, any_value(source) AS source, any_value(n_chars) AS n_chars,
        list(100 * list_inner_product(vec, prototype) ORDER BY p.label) AS logits,
        CAST(arg_min(p.label, (-list_inner_product(vec, prototype), p.label)) AS INTEGER) AS y_pred
    FROM pool_emb e, prototypes p GROUP BY e.doc_id
    """,
)
sql_view(
    "ranked",
    """
    SELECT *, 1 + len(list_filter(range(len(logits)), lambda i: logits[i + 1] > logits[y_true + 1]
        OR (logits[i + 1] = logits[y_true + 1] AND i < y_true))) AS true_rank FROM preds
    """,
)


def faces(predicted: DataFrame) -> DataFrame:
    """Race, gender, age and toxicity classes worked out from prediction and text length."""
    race = F.col("y_true") % 7
    return predicted.select(
        race.alias("race"),
        (race != 1).cast("int").alias("race_binary"),
        (F.col("n_chars") % 2).cast("int").alias("gender"),
        (F.col("y_true") % 9).cast("int").alias("age"),
        (F.col("y_pred") % 7).alias("pred_race"),
        ((F.col("n_chars") + F.col("y_pred")) % 2).cast("int").alias("pred_gender"),
        ((F.col("y_pred") + F.col("n_chars") % 2) % 9).cast("int").alias("pred_age"),
        ((F.col("n_chars") * 7 + F.col("y_pred")) % 24).cast("int").alias("pred_toxic"),
    )


sql_view(
    "faces",
    """
    SELECT y_true % 7 AS race, CAST(y_true % 7 <> 1 AS INTEGER) AS race_binary, n_chars % 2 AS gender, y_true % 9 AS age,
        y_pred % 7 AS pred_race, (n_chars + y_pred) % 2 AS pred_gender, (y_pred + n_chars % 2) % 9 AS pred_age,
        (n_chars * 7 + y_pred) % 24 AS pred_toxic FROM preds
    """,
)


def association_items(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as items: some positions are candidates, scored by their value.

    The labels give items of 5 to 16 candidates, some without any right one.
    """
    place = F.sequence(F.lit(0), F.size("embedding") - 1)
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        "embedding",
        F.filter(place, lambda p: p % (F.col("label") + 4) == 0).alias("candidates"),
        F.filter(place, lambda p: p % 3 == F.col("label") % 4).alias("associations"),
    )
    return items.withColumn(
        "scores", F.transform("candidates", lambda p: F.get("embedding", p))
    ).drop("embedding")


sql_view(
    "association_rows",
    """
    SELECT *, sum(CAST(is_true AS INTEGER)) OVER (PARTITION BY item_id) AS n_true,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos DESC) AS rank_no
    FROM (SELECT item_id, pos, score, pos % 3 = label % 4 AS is_true
          FROM (SELECT vec_id AS item_id, label, unnest(embedding) AS score, unnest(range(len(embedding))) AS pos
                FROM embeddings) WHERE pos % (label + 4) = 0)
    """,
)
sql_view(
    "association_jaccard",
    """
    SELECT item_id, count(*) AS candidates_n, coalesce(
        CAST(sum(CAST(is_true AND (n_true = 0 OR rank_no <= n_true) AS INTEGER)) AS DOUBLE)
        / nullif(sum(CAST(is_true OR n_true = 0 OR rank_no <= n_true AS INTEGER)), 0), 0) AS jaccard
    FROM association_rows GROUP BY item_id
    """,
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as result lines: one dataset per nation, a run per market segment."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dataset")
    )
    score = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / F.lit(10000.0))
    return (
        table(spark, sf, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("seq"),
            F.col("c_name").alias("key"),
            F.col("c_mktsegment").alias("run"),
            "dataset",
            F.create_map(
                F.lit("acc1"), score, F.lit("acc5"), F.col("c_acctbal") / F.lit(20011.0) + F.lit(0.5)
            ).alias("metrics"),
        )
    )


sql_view(
    "results",
    """
    SELECT c_custkey AS seq, c_name AS key, c_mktsegment AS run, n_name AS dataset,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000::DOUBLE END AS acc1, c_acctbal / 20011::DOUBLE + 0.5::DOUBLE AS acc5
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
sql_view(
    "latest",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) AS place FROM results) WHERE place = 1",
)


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as tasks, tagged with their region; some name another main metric."""
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        table(spark, sf, "nation")
        .join(region, "n_regionkey")
        .select(
            F.concat(F.lit("task/"), F.col("n_nationkey").cast("string")).alias("key"),
            F.col("n_name").alias("name"),
            (F.col("n_nationkey") * 100).cast("bigint").alias("size"),
            F.when(F.col("n_regionkey") == 0, "acc5").alias("main_metric"),
            (F.col("n_nationkey") + 2).alias("num_classes"),
            (F.lit(1.0) / (F.col("n_nationkey") + 2)).alias("random_score"),
            F.array("r_name").alias("tags"),
        )
    )


sql_view(
    "tasks",
    """
    SELECT 'task/' || CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_nationkey * 100 AS BIGINT) AS size,
        CASE WHEN n_regionkey = 0 THEN 'acc5' END AS main_metric, n_nationkey + 2 AS num_classes,
        1::DOUBLE / (n_nationkey + 2) AS random_score, r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
)
sql_view(
    "scored",
    """
    SELECT l.dataset, CASE WHEN t.main_metric = 'acc5' THEN l.acc5 ELSE l.acc1 END AS main_metric
    FROM latest l LEFT JOIN tasks t ON l.dataset = t.name
    """,
)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).select(F.col("tags")[0].alias("group"), F.col("name").alias("dataset"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def images(spark: SparkSession, sf: str) -> DataFrame:
    """One image file per conversation."""
    return conversations(spark, sf).select(
        F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("path")
    ).distinct()


def caption_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as captions; later turns replace earlier ones."""
    return conversations(spark, sf).filter("role = 'assistant'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("filename"),
        F.col("text").alias("caption"),
        F.md5(F.concat_ws(":", "conv_id", "turn")).alias("uid"),
        F.col("turn").alias("seq"),
    )


def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as alternative texts next to the image."""
    return conversations(spark, sf).filter("role = 'user'").select(
        F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("alt_text"),
    )


sql_view(
    "matched_captions",
    """
    SELECT i.conv_id, i.path, coalesce(trim(s.alt), '') AS alt_text, c.caption, c.uid, c.conv_id IS NOT NULL AS hit
    FROM (SELECT DISTINCT conv_id, 'img/' || CAST(conv_id AS VARCHAR) || '.jpg' AS path FROM conversations) i
    LEFT JOIN (SELECT conv_id, text AS caption, md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS uid
               FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place
                     FROM conversations WHERE role = 'assistant') WHERE place = 1) c ON c.conv_id = i.conv_id
    LEFT JOIN (SELECT conv_id, max(text) AS alt FROM conversations WHERE role = 'user' GROUP BY conv_id) s
        ON s.conv_id = i.conv_id
    """,
)
