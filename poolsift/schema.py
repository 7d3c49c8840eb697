"""Fixed schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_boxes = T.ArrayType(T.ArrayType(T.DoubleType()))
_vector = T.ArrayType(T.FloatType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POOL = _schema(
    uid=T.StringType(),
    url=T.StringType(),
    text=T.StringType(),
    original_width=T.IntegerType(),
    original_height=T.IntegerType(),
    clip_b32_similarity_score=T.DoubleType(),
    clip_l14_similarity_score=T.DoubleType(),
    face_bboxes=_boxes,
)
EMBEDDINGS = _schema(file_stem=T.StringType(), row_idx=T.LongType(), vec=_vector)
CENTROIDS = _schema(centroid_id=T.IntegerType(), centroid=_vector)
SUBSET = _schema(uid=T.StringType())
LEXICON = _schema(word=T.StringType(), synset_offset=T.IntegerType())
SHARD_SIZES = _schema(shard_name=T.StringType(), size=T.LongType())
SHARD_STATS = _schema(successes=T.LongType())
BLUR_MAP = T.MapType(
    T.StringType(), _schema(parquet=T.StringType(), shards=T.ArrayType(T.StringType()))
)
BOXES = _schema(uid=T.StringType(), face_bboxes=_boxes)
CAPTIONS = _schema(
    filename=T.StringType(), alt_text=T.StringType(), caption=T.StringType(), uid=T.StringType()
)
RESULTS = _schema(
    key=T.StringType(),
    dataset=T.StringType(),
    metrics=T.MapType(T.StringType(), T.DoubleType()),
)
TASKS = _schema(
    key=T.StringType(),
    name=T.StringType(),
    size=T.LongType(),
    main_metric=T.StringType(),
    num_classes=T.IntegerType(),
    random_score=T.DoubleType(),
    tags=T.ArrayType(T.StringType()),
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return ``df`` unchanged, or fail before any job runs if a column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; have {df.columns}")
    return df
