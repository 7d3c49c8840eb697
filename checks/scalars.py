"""Column functions."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import pool, prototypes, sql_words, table
from poolsift.functions import ids, images, prompts, text, vectors
from poolsift.sources.vector_files import detect_language


@check(
    "uid_split",
    """
    SELECT uid, CAST(('0x' || substr(uid, 1, 16))::UBIGINT AS DECIMAL(20,0)) AS hi,
        CAST(('0x' || substr(uid, 17, 16))::UBIGINT AS DECIMAL(20,0)) AS lo, uid AS joined FROM pool
    """,
)
def uid_split(spark, sf):
    rows = pool(spark, sf).select("uid", ids.uid_hi(F.col("uid")).alias("hi"), ids.uid_lo(F.col("uid")).alias("lo"))
    return rows.withColumn("joined", ids.uid_from_pair(F.col("hi"), F.col("lo")))


@check("caption_word_count", f"SELECT uid, CAST(len({sql_words('text')}) AS INTEGER) AS words FROM pool")
def caption_word_count(spark, sf):
    return pool(spark, sf).select("uid", text.word_count(F.col("text")).alias("words"))


@check("caption_char_count", "SELECT uid, CAST(length(text) AS INTEGER) AS chars FROM pool")
def caption_char_count(spark, sf):
    return pool(spark, sf).select("uid", text.char_count(F.col("text")).alias("chars"))


@check(
    "caption_truncate",
    f"SELECT uid, array_to_string(list_slice({sql_words('text')}, 1, 30), ' ') AS short FROM pool",
)
def caption_truncate(spark, sf):
    return pool(spark, sf).select("uid", text.truncate_words(F.col("text"), 30).alias("short"))


@check("single_line", "SELECT uid, replace(text, chr(10), ' ') AS line FROM pool")
def single_line(spark, sf):
    return pool(spark, sf).select("uid", text.single_line(F.col("text")).alias("line"))


@check(
    "image_dims",
    """
    SELECT uid, CASE WHEN original_width IS NOT NULL THEN least(original_width, original_height) END AS short_side,
        CASE WHEN original_width IS NOT NULL THEN greatest(original_width, original_height) END AS long_side,
        round(CASE WHEN original_width IS NOT NULL THEN greatest(original_width, original_height)::DOUBLE
            / least(original_width, original_height)::DOUBLE END, 6) AS aspect
    FROM pool
    """,
)
def image_dims(spark, sf):
    w, h = F.col("original_width"), F.col("original_height")
    return pool(spark, sf).select(
        "uid",
        images.min_side(w, h).alias("short_side"),
        images.max_side(w, h).alias("long_side"),
        F.round(images.aspect_ratio(w, h), 6).alias("aspect"),
    )


def _marker_detector():
    """A stand-in for a language model: the first language whose marker word occurs."""
    markers = {"en": " the ", "fr": " le ", "de": " der "}
    return lambda lines: [next((k for k, m in markers.items() if m in t), "und") for t in lines]


@check(
    "add_language",
    """
    SELECT uid, CASE WHEN contains(line, ' the ') THEN 'en' WHEN contains(line, ' le ') THEN 'fr'
        WHEN contains(line, ' der ') THEN 'de' ELSE 'und' END AS detected
    FROM (SELECT uid, replace(text, chr(10), ' ') AS line FROM pool)
    """,
)
def add_language(spark, sf):
    rows = detect_language(pool(spark, sf), _marker_detector, output="detected")
    return rows.select("uid", "detected")


@check("json_uid", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_uid(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


@check(
    "path_stem",
    r"""
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '([^/]+?)(\.[^./]+)?$', 1) AS stem,
        lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS suffix FROM pages
    """,
)
def path_stem(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        text.base_name(url).alias("name"),
        text.path_stem(url).alias("stem"),
        text.path_suffix(url).alias("suffix"),
    )


@check(
    "prompt_column",
    f"""
    SELECT filename, CASE WHEN length(alt) > 0 OR length(caption) > 0 THEN
        replace(replace('{prompts.GUIDED_PROMPT.replace("%s", "#ALT#", 1).replace("%s", "#CAP#", 1)}',
            '#ALT#', CASE WHEN length(alt) > 0 THEN alt ELSE '(none)' END),
            '#CAP#', CASE WHEN length(caption) > 0 THEN caption ELSE '(none)' END)
        ELSE '{prompts.PLAIN_PROMPT}' END AS prompt
    FROM (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS filename,
            CASE WHEN role = 'user' THEN text END AS alt, CASE WHEN role = 'assistant' THEN text ELSE '' END AS caption
          FROM conversations)
    """,
)
def prompt_column(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("filename"),
        F.when(F.col("role") == "user", F.col("text")).alias("alt"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("caption"),
    )
    return rows.select("filename", prompts.caption_prompt(F.col("alt"), F.col("caption")).alias("prompt"))


@check(
    "cue_prompt",
    """
    SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '^[aeiou]') THEN 'An ' ELSE 'A ' END || lower(p_type) AS prompt
    FROM part
    """,
)
def cue_prompt(spark, sf):
    return table(spark, sf, "part").select("p_partkey", prompts.cue_prompt(F.col("p_type")).alias("prompt"))


@check(
    "objective_split",
    """
    SELECT page_id, substr(url, 1, strpos(url, ':') - 1) AS objective, substr(url, strpos(url, ':') + 1) AS label FROM pages
    """,
)
def objective_split(spark, sf):
    objective, label = text.split_objective(F.col("url"))
    return table(spark, sf, "pages").select("page_id", objective.alias("objective"), label.alias("label"))


@check("shard_name", "SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.tar' AS name, doc_id AS number FROM documents")
def shard_name(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", text.shard_name(F.col("doc_id")).alias("name"))
    return named.withColumn("number", text.shard_number(F.col("name")))


@check(
    "percent_format",
    "SELECT l_orderkey, l_linenumber, printf('%.1f', round(l_discount * 100, 1)) AS percent FROM lineitem",
)
def percent_format(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.percent_text(F.col("l_discount")).alias("percent")
    )


@check(
    "l2_normalize",
    """
    SELECT vec_id, pos, round(x / n, 6) AS x FROM (
        SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos,
            sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
    """,
)
def l2_normalize(spark, sf):
    v = F.col("embedding")
    rows = table(spark, sf, "embeddings").withColumn("size", vectors.norm(v))
    unit = vectors.l2_normalize(v, F.col("size"))
    parts = rows.select("vec_id", F.posexplode(unit).alias("pos", "x"))
    return parts.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@check(
    "dot_product",
    """
    SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], p.prototype), 6) AS score
    FROM embeddings e JOIN prototypes p ON e.label = p.label
    """,
)
def dot_product(spark, sf):
    rows = table(spark, sf, "embeddings").join(prototypes(spark, sf), "label")
    return rows.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("prototype")), 6).alias("score"))
