import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.operators import clustering, nearest, tiles
from poolsift.operators.metrics import retrieval


def vectors(spark, matrix, key="uid", vec="vec", kind="string"):
    rows = [(f"{i:032x}" if kind == "string" else i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} {kind}, {vec} array<double>")


def centroid_table(spark, matrix, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids or range(len(matrix)), matrix)]
    return spark.createDataFrame(rows, "centroid_id int, centroid array<double>")


def assignment(df):
    return {int(r.uid, 16): r.centroid_id for r in df.collect()}


def test_ties_take_the_lowest_id(spark):
    points = vectors(spark, [[1.0, 0.0]])
    cents = centroid_table(spark, [[1.0, 0.0], [0.5, 0.0], [1.0, 0.0]], [7, 1, 3])
    for limit in (1 << 30, 90):
        got = nearest.nearest(points, cents, tile_bytes=limit)
        assert assignment(got) == {0: 3}


def test_inner_product_decides_not_distance(spark):
    points = vectors(spark, [[1.0, 0.1]])
    cents = centroid_table(spark, [[1.0, 0.0], [5.0, 5.0]])
    assert assignment(nearest.nearest(points, cents)) == {0: 1}
    assert assignment(nearest.nearest(points, cents, metric="l2")) == {0: 0}


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_blocks_agree_with_one_matrix(spark, metric):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(300, 6)), rng.normal(size=(37, 6))
    points, cents = vectors(spark, x).repartition(4), centroid_table(spark, c)
    points = points.unionAll(points.limit(5))  # repeated ids
    whole = nearest.nearest(points, cents, metric=metric)
    split = nearest.nearest(points, cents, metric=metric, tile_bytes=500)
    score = x @ c.T if metric == "dot" else -((x[:, None] - c[None]) ** 2).sum(-1)
    want = dict(enumerate(score.argmax(axis=1).tolist()))
    assert assignment(whole) == want == assignment(split)
    assert whole.count() == split.count() == 305
    few = nearest.covered_centroids(points, cents)
    many = nearest.covered_centroids(points, cents, tile_bytes=500)
    if metric == "dot":
        assert {r[0] for r in few.collect()} == {r[0] for r in many.collect()} == set(want.values())


def test_unusable_vectors_are_dropped(spark):
    points = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 2.0])], "uid string, vec array<float>"
    )
    got = nearest.nearest(points, centroid_table(spark, [[1.0, 0.0], [0.0, 1.0]]))
    assert {r.uid: r.centroid_id for r in got.collect()} == {"a": 0, "d": 1}
    with pytest.raises(ValueError):
        nearest.nearest(points, centroid_table(spark, [[1.0], [0.0, 1.0]]))


def test_null_keys_and_repeated_vectors_stay_with_many_blocks(spark):
    points = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), ("c", [0.0, 1.0])], "uid string, vec array<float>")
    cents = centroid_table(spark, [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5], [0.1, 0.9]])
    for limit in (1 << 30, 90):
        got = nearest.nearest(points, cents, tile_bytes=limit).collect()
        assert sorted((r.uid or "", r.centroid_id) for r in got) == [("", 0), ("", 0), ("c", 1)]


def test_objectives_have_no_limit_of_classes(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id int, vec array<float>")
    rows = [("a", f"c{i}", [float(i % 7), float(i % 5)]) for i in range(400)] + [("b", "x", [0.0, 0.0]), ("b", "y", [0.0, -1.0])]
    learned = spark.createDataFrame(rows, "objective string, class_id string, prototype array<double>")
    got = {r.id: (r.pred_a, r.pred_b) for r in clustering.predict_objectives(points, learned).collect()}
    first = lambda at, top: min(r[1] for r in rows[:400] if r[2][at] == top)
    assert got == {1: (first(0, 6.0), "x"), 2: (first(1, 4.0), "x"), 3: (None, None)}


def test_training_reads_its_input_once(spark, tmp_path):
    spark.range(60).selectExpr("string(id) AS uid", "array(float(id % 7), float(id % 5)) AS vec").write.parquet(f"{tmp_path}/p")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = spark.read.parquet(f"{tmp_path}/p").mapInArrow(count, "uid string, vec array<float>")
    clustering.train_kmeans(points, 3, iterations=4)
    assert read.value == 60


def test_short_tiles_are_never_opened(spark, monkeypatch):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=(20, 4)) * 10, rng.normal(size=(60, 4)) * 0.01
    table = centroid_table(spark, np.concatenate([short, long])).orderBy(F.col("centroid_id")).coalesce(1)
    ready = tiles.write_tiles(table, "centroid_id", "centroid", tile_bytes=20 * 4 * 8)
    assert [t.rows for t in ready.tiles] == [20] * 4 and ready.tiles[0].low > ready.tiles[1].high
    opened = []
    read = ready.reader()
    points = rng.normal(size=(50, 4))

    def counted(tile):
        opened.append(tile.name)
        return read(tile)

    best, score = nearest.best_in_tiles(points, ready, "dot", counted)
    every = np.concatenate([short, long])
    assert best.tolist() == (points @ every.T).argmax(1).tolist()
    np.testing.assert_allclose(score, (points @ every.T).max(1))
    assert set(opened) == {ready.tiles[0].name}
    ready.drop()
    with pytest.raises(FileNotFoundError):
        ready.reader()(ready.tiles[0])


def test_small_tiles_are_put_together_and_ids_may_be_texts(spark):
    table = spark.createDataFrame([(f"k{i:03d}", [float(i), 1.0]) for i in range(40)], "k string, v array<float>").repartition(16)
    ready = tiles.write_tiles(table, "k", "v")
    assert len(ready.tiles) == 1 and ready.rows == 40 and (ready.tiles[0].low, ready.tiles[0].high) == (1.0, np.hypot(39, 1))
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id int, vec array<float>")
    found = {r.id: r.m and r.m.id for r in nearest.best_of(points, ready, "vec", "dot", "m").collect()}
    assert found == {1: "k039", 2: "k000", 3: "k000", 4: None}
    with pytest.raises(ValueError, match="no vectors"):
        tiles.write_tiles(table.limit(0), "k", "v")
    with pytest.raises(ValueError, match="differ in length"):
        tiles.write_tiles(table.unionAll(spark.createDataFrame([("x", [1.0])], table.schema)).repartition(1), "k", "v")


def test_score_arrays(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, vec array<float>")
    classes = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, p array<double>")
    got = nearest.scores_against(points, classes, "k", "p", scale=10.0).orderBy("id").collect()
    assert got[0].logits == [20.0, 10.0] and got[1].logits is None


def test_lloyd_step_and_training(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.1, size=(60, 3)) for m in (-3, 0, 3)])
    points = vectors(spark, x).repartition(3)
    start = centroid_table(spark, x[[0, 1, 70, 150]])
    label = ((x[:, None] - x[[0, 1, 70, 150]][None]) ** 2).sum(-1).argmin(1)
    for limit in (1 << 30, 200):
        moved = clustering.kmeans_step(points, start, tile_bytes=limit).collect()
        for r in moved:
            assert r.n == (label == r.centroid_id).sum()
            np.testing.assert_allclose(r.centroid, x[label == r.centroid_id].mean(axis=0))
    losses = [
        clustering.inertia(points, clustering.train_kmeans(points, 3, n, seed=4)).first().inertia
        for n in (0, 1, 6)
    ]
    assert losses[0] >= losses[1] >= losses[2]
    again = clustering.train_kmeans(points.repartition(7), 3, 6, seed=4)
    assert abs(clustering.inertia(points, again).first().inertia - losses[2]) < 1e-9
    with pytest.raises(ValueError):
        clustering.train_kmeans(points, 1000)


def test_training_is_lloyds_algorithm(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    points = vectors(spark, x).repartition(5)
    start = clustering.seed_centroids(points, 7, seed=3).orderBy("centroid_id").collect()
    c = np.array([r.centroid for r in start])
    assert [r.centroid_id for r in start] == list(range(7))
    for _ in range(4):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(7)])
    for limit in (1 << 30, 400):
        got = clustering.train_kmeans(points, 7, 4, seed=3, tile_bytes=limit).orderBy("centroid_id").collect()
        np.testing.assert_allclose(np.array([r.centroid for r in got]), c)


def test_prototypes_per_objective(spark):
    rows = [("race", 0, [1.0, 0.0]), ("race", 0, [0.0, 1.0]), ("age", 0, [0.0, 2.0]), ("age", 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "objective string, class_id int, vec array<double>")
    got = {(r.objective, r.class_id): r.prototype for r in clustering.class_prototypes(df, ["objective", "class_id"]).collect()}
    np.testing.assert_allclose(got["race", 0], [2**-0.5, 2**-0.5])
    np.testing.assert_allclose(got["age", 0], [0.0, 1.0])
    np.testing.assert_allclose(got["age", 1], [0.0, 0.0])


@pytest.mark.parametrize("n_query, n_cand", [(40, 25), (25, 40)])
def test_retrieval_recall_matches_the_score_matrix(spark, n_query, n_cand):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(n_query, 5)), rng.normal(size=(n_cand, 5))
    pairs = sorted({(int(rng.integers(n_query)), int(rng.integers(n_cand))) for _ in range(60)})
    match = np.zeros((n_query, n_cand), bool)
    match[tuple(zip(*pairs))] = True
    score = q @ c.T
    asked = match.any(axis=1)
    order = np.argsort(-score, axis=1)
    want = {k: np.take_along_axis(match, order[:, :k], 1).any(1)[asked].mean() for k in (1, 5, 10)}
    queries = vectors(spark, q, "id", kind="bigint").repartition(3)
    cands = vectors(spark, c, "id", kind="bigint").repartition(3)
    table = spark.createDataFrame(pairs, "query_id bigint, candidate_id bigint")
    for limit in (1 << 30, 600):
        row = retrieval.retrieval_recall(queries, cands, table, tile_bytes=limit).first()
        assert row.queries == asked.sum()
        for k in want:
            assert abs(row[f"recall_{k}"] - want[k]) < 1e-12
    long = [(i, j, float(score[i, j]), bool(match[i, j])) for i in range(n_query) for j in range(n_cand)]
    scores = spark.createDataFrame(long, "query int, cand int, score double, is_match boolean")
    row = retrieval.retrieval_recall_from_scores(scores, "query", "cand").first()
    assert abs(row.recall_5 - want[5]) < 1e-12


def test_vector_functions(spark):
    from poolsift.functions import vectors as V

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = df.select(V.l2_normalize(F.col("v")).alias("u"), V.norm(F.col("v")).alias("n")).collect()
    np.testing.assert_allclose(rows[0].u, [0.6, 0.8])
    assert rows[1].u == [0.0, 0.0] and rows[0].n == 5.0
