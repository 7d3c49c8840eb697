import io
import json
import os
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from poolsift.plans import curation, resharding
from poolsift.plans.curation import curate_to, curate_to_subset_file
from poolsift.operators.filters import FilterSpec
from poolsift.plans.resharding import plan_copies, reshard
from poolsift.sources import audit, csv_files, images, subset_files, tables, tars, vector_files


def write_tar(path, members):
    with tarfile.open(path, "w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def sample(uid, size=10, extra=()):
    return [(f"{uid}.json", json.dumps({"uid": uid * 32, "k": 1}).encode()), (f"{uid}.JPG", uid.encode() * size), *extra]


# -- subset files -------------------------------------------------------------


def numpy_subset(uids):
    array = np.array([(int(u[:16], 16), int(u[16:], 16)) for u in uids], np.dtype("u8,u8"))
    array.sort()
    return array


def test_subset_files_of_both_kinds_are_read_in_ranges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    uids = sorted(rng.bytes(16).hex() for _ in range(1000)) + ["f" * 32] * 3
    np.save(tmp_path / "s.npy", numpy_subset(uids))
    numpy_subset(uids).tofile(tmp_path / "bare.bin")
    monkeypatch.setattr(subset_files, "RECORDS_PER_PARTITION", 300)
    for name in ("s.npy", "bare.bin"):
        df = subset_files.read_subset(spark, str(tmp_path / name))
        assert sorted(r.uid for r in df.collect()) == sorted(uids)
    assert len(subset_files.SubsetReader(str(tmp_path / "s.npy")).partitions()) == 4


@pytest.mark.parametrize("raw", [False, True])
def test_written_parts_load_in_order(spark, tmp_path, raw):
    rng = np.random.default_rng(1)
    uids = [rng.bytes(16).hex() for _ in range(500)] * 2
    df = spark.createDataFrame([(u,) for u in uids], "uid string").repartition(6)
    folder = str(tmp_path / "out")
    subset_files.write_subset(df, folder, raw=raw)
    parts = json.load(open(f"{folder}/_parts.json"))
    load = (lambda p: np.fromfile(p, np.dtype("u8,u8"))) if raw else np.load
    whole = np.concatenate([load(f"{folder}/{p['name']}") for p in parts])
    assert (whole == numpy_subset(uids)).all()
    assert sorted(r.uid for r in subset_files.read_subset(spark, folder).collect()) == sorted(uids)


def test_broken_subset_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros(4))
    (tmp_path / "y.bin").write_bytes(b"123")
    for name in ("x.npy", "y.bin"):
        with pytest.raises(Exception, match="uint64|16-byte"):
            subset_files.read_subset(spark, str(tmp_path / name)).collect()
    unsorted = spark.createDataFrame([("f" * 32,), ("0" * 32,)], "uid string").coalesce(1)
    with pytest.raises(Exception, match="sorted"):
        unsorted.write.format("subset_ids").mode("append").save(str(tmp_path / "z"))


def test_a_second_run_replaces_the_subset(spark, tmp_path):
    folder = str(tmp_path / "again")
    ids = [f"{i:032x}" for i in range(40)]
    frame = lambda some: spark.createDataFrame([(u,) for u in some], "uid string").repartition(4)
    subset_files.write_subset(frame(ids), folder)
    subset_files.write_subset(frame(ids[:7]), folder)
    assert sorted(r.uid for r in subset_files.read_subset(spark, folder).collect()) == ids[:7]
    with pytest.raises(Exception, match="not empty"):
        frame(ids).orderBy("uid").write.format("subset_ids").mode("append").save(folder)
    # a part that a lost or speculative task left behind is in no listing
    np.save(f"{folder}/part-000000-0badf00d.npy", numpy_subset(ids))
    assert subset_files.read_subset(spark, folder).count() == 7
    subset_files.write_subset(frame(ids[:3]), folder)
    assert len([p for p in os.listdir(folder) if p.startswith("part-")]) == len(json.load(open(f"{folder}/_parts.json")))
    os.remove(f"{folder}/_parts.json")
    with pytest.raises(Exception, match="did not end"):
        subset_files.read_subset(spark, folder).collect()


def test_a_hot_id_does_not_fill_one_part(spark, tmp_path):
    hot = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN repeat('7', 32) ELSE md5(cast(id AS string)) END AS uid")
    folder = str(tmp_path / "hot")
    subset_files.write_subset(hot, folder)
    parts = [np.load(f"{folder}/{p['name']}") for p in json.load(open(f"{folder}/_parts.json"))]
    assert (np.concatenate(parts) == numpy_subset([r.uid for r in hot.collect()])).all()


def test_curation_writes_sorted_ids(spark, tmp_path):
    pool = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("uid")).repartition(4)
    want = sorted(r.uid for r in pool.collect())
    curate_to(pool, FilterSpec("no_filter"), str(tmp_path / "p"))
    files = sorted(f for f in os.listdir(tmp_path / "p") if f.endswith(".parquet"))
    got = [r.uid for f in files for r in spark.read.parquet(str(tmp_path / "p" / f)).collect()]
    assert got == want
    curate_to_subset_file(pool, FilterSpec("no_filter"), str(tmp_path / "n"))
    assert sorted(r.uid for r in subset_files.read_subset(spark, str(tmp_path / "n")).collect()) == want


# -- tar shards ---------------------------------------------------------------


def test_members_and_samples_follow_prefix_and_suffix_rules(spark, tmp_path):
    write_tar(tmp_path / "00000000.tar", [("a.json", b"1"), ("a.jpg", b"2"), ("a.json", b"3"), ("noext", b"x"), ("d/b.c.TXT", b"4")])
    write_tar(tmp_path / "00000001.tar", [("p.x", b"1"), ("p.x", b"2"), ("p.y", b"3"), ("p.y", b"4")])
    members = tars.read_members(spark, str(tmp_path), suffixes=("json",)).orderBy("shard", "member_idx").collect()
    assert [(m.prefix, m.suffix) for m in members[:4]] == [("a", "json"), ("a", "jpg"), ("a", "json"), ("d/b", "c.txt")]
    assert members[0].data == b"1" and members[1].data is None and members[1].size == 1
    got = [(s.shard, s.sample_idx, s.key, s.members) for s in tars.read_samples(spark, str(tmp_path)).orderBy("shard", "sample_idx").collect()]
    assert [(g[2], {k: bytes(v) for k, v in g[3].items()}) for g in got] == [
        ("a", {"json": b"1", "jpg": b"2"}), ("a", {"json": b"3"}), ("d/b", {"c.txt": b"4"}),
        ("p", {"x": b"1"}), ("p", {"x": b"2", "y": b"3"}), ("p", {"y": b"4"}),
    ]


def test_bad_shards_and_samples_are_reported(spark, tmp_path):
    write_tar(tmp_path / "0.tar", [*sample("a"), ("b.jpg", b"no json"), ("c.json", b"{bad"), ("d.json", b"{}")])
    write_tar(tmp_path / "1.tar", [*sample("e", 5000), *sample("f", 5000)])
    whole = (tmp_path / "1.tar").read_bytes()
    (tmp_path / "1.tar").write_bytes(whole[:8000])
    (tmp_path / "2.tar").write_bytes(b"not a tar file" * 100)
    index = tars.index_samples(spark, str(tmp_path)).collect()
    good = [(r.shard, r.key) for r in index if r.error is None]
    bad = sorted((r.shard, r.key) for r in index if r.error is not None and r.key)
    assert ("0.tar", "a") in good and bad == [("0.tar", "b"), ("0.tar", "c"), ("0.tar", "d")]
    broken = {r.shard for r in index if r.error is not None and r.key is None}
    assert "2.tar" in broken
    members = tars.read_members(spark, str(tmp_path)).filter("error IS NOT NULL")
    assert {r.shard for r in members.collect()} == {"1.tar", "2.tar"}


@pytest.fixture
def shards(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_tar(folder / "00000000.tar", sample("a") + sample("b", 2000) + sample("c"))
    write_tar(folder / "00000001.tar", sample("d") + sample("a") + sample("e", 3000) + [("z.jpg", b"no json")])
    return str(folder)


def out_samples(folder):
    found = {}
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".tar")):
        with tarfile.open(f"{folder}/{name}") as archive:
            found[name] = [(i.name, archive.extractfile(i).read()) for i in archive]
    return found


def test_reshard_end_to_end(spark, shards, tmp_path):
    out = str(tmp_path / "out")
    wanted = ["a", "a", "e", "c", "x"]
    subset = spark.createDataFrame([(u * 32,) for u in wanted], "uid string")
    boxes = spark.createDataFrame([("e" * 32, [[1.0, 2.0, 3.0, 4.0]]), ("c" * 32, [])], "uid string, face_bboxes array<array<double>>")
    report = reshard(spark, shards, subset, out, shard_size=4, boxes=boxes)
    # "a" occurs twice in the pool and twice in the subset: four copies.
    assert (report.processed_count, report.unreadable_count, report.requested_count) == (6, 1, 5)
    assert (report.output_count, report.output_shard_count, report.failed_count) == (6, 2, 0)
    found = out_samples(out)
    assert {n: len(m) // 2 for n, m in found.items()} == {"00000000.tar": 4, "00000001.tar": 2}
    names = [name for m in found.values() for name, _ in m if name.endswith(".json")]
    a, c, e = "a" * 32, "c" * 32, "e" * 32
    assert names == [f"{k}.json" for k in (f"{a}-0", f"{a}-1", f"{c}-0", f"{a}-0", f"{a}-1", f"{e}-0")]
    content = dict(found["00000001.tar"])
    assert json.loads(content[f"{e}-0.json"]) == {"uid": e, "k": 1, "face_bboxes": [[1.0, 2.0, 3.0, 4.0]]}
    assert content[f"{e}-0.jpg"] == b"e" * 3000
    assert "face_bboxes" not in json.loads(dict(found["00000000.tar"])[f"{c}-0.json"])
    assert json.load(open(f"{out}/00000001_stats.json")) == {"successes": 2}
    meta = json.load(open(f"{out}/meta.json"))
    assert meta["output_shard_count"] == 2 and meta["boxes_missing_count"] == 4
    assert {tuple(r) for r in tables.read_shard_sidecars(spark, out).collect()} == {("00000000.tar", 4), ("00000001.tar", 2)}


def test_reshard_by_bytes_and_in_seeded_order(spark, shards, tmp_path):
    subset = spark.createDataFrame([(u * 32,) for u in "aabcde"], "uid string")
    index = tars.index_samples(spark, shards).cache()
    plan = plan_copies(index, subset, shard_size=100, max_bytes=2000).collect()
    filled, last = {}, {}
    for r in sorted(plan, key=lambda r: r.position):
        assert r.shard_id not in last or filled[r.shard_id] < 2000
        filled[r.shard_id] = filled.get(r.shard_id, 0) + r.bytes
        last[r.shard_id] = r.position
    assert len(plan) == 8 and len(filled) > 1
    one = plan_copies(index, subset, shard_size=3, shuffle_seed=1).select("shard_id", "position", "key", "shard").collect()
    two = plan_copies(index.repartition(5), subset, shard_size=3, shuffle_seed=1).select("shard_id", "position", "key", "shard").collect()
    assert sorted(one) == sorted(two) and sorted(r.position for r in one) == list(range(8))
    out = str(tmp_path / "edited")
    drop_image = lambda members, boxes: {"json": members["json"]}
    report = reshard(spark, shards, subset, out, shard_size=3, index=index, edit=drop_image)
    with pytest.raises(FileExistsError):
        reshard(spark, shards, subset, out, shard_size=3, index=index)
    fewer = reshard(spark, shards, subset.limit(1), out, shard_size=3, index=index, overwrite=True)
    assert fewer.output_shard_count == len([f for f in os.listdir(out) if f.endswith(".tar")])
    report = reshard(spark, shards, subset, out, shard_size=3, index=index, edit=drop_image, overwrite=True)
    assert report.output_count == 8
    assert all(name.endswith(".json") for m in out_samples(out).values() for name, _ in m)


def test_a_shuffled_reshard_opens_a_source_once_per_task(spark, tmp_path, monkeypatch):
    from pyspark import TaskContext

    folder, log = tmp_path / "shards", tmp_path / "opens"
    folder.mkdir()
    log.mkdir()
    for number in range(6):
        ids = [f"{number * 100 + i:032x}" for i in range(100)]
        write_tar(folder / f"{number:08d}.tar", [m for u in ids for m in ((f"{u}.json", json.dumps({"uid": u}).encode()), (f"{u}.jpg", u.encode()))])
    subset = spark.range(600).selectExpr("format_string('%032x', id) AS uid").unionAll(spark.createDataFrame([(f"{7:032x}",)] * 3, "uid string"))
    plain = tars.open_input

    def logged(path, folder=str(log)):
        with open(f"{folder}/{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}", "a") as file:
            file.write(path + "\n")
        return plain(path)

    index = tars.index_samples(spark, str(folder)).cache()
    monkeypatch.setattr(resharding, "SHUFFLE_RUN", 10)
    monkeypatch.setattr(tars, "MIX_SAMPLES", 20)
    monkeypatch.setattr(tars, "open_input", logged)
    reports = [reshard(spark, str(folder), subset, str(tmp_path / f"out{i}"), 50, index=index, shuffle_seed=5) for i in range(2)]
    monkeypatch.undo()
    opened = [file.read_text().split() for file in log.iterdir()]
    assert opened and all(len(paths) == len(set(paths)) for paths in opened)
    assert [(r.output_count, r.output_shard_count) for r in reports] == [(603, 13)] * 2
    one, two = (out_samples(str(tmp_path / f"out{i}")) for i in range(2))
    assert one == two
    keys = [name.split(".")[0].split("-")[0] for n in sorted(one) for name, _ in one[n] if name.endswith(".json")]
    assert sorted(keys) == sorted([f"{i:032x}" for i in range(600)] + [f"{7:032x}"] * 3)
    # neighbours of the input are apart, and an output shard holds samples of several inputs
    near = sum(abs(int(a, 16) - int(b, 16)) == 1 for a, b in zip(keys, keys[1:]))
    assert near < 120
    mixed = [len({int(name.split("-")[0], 16) // 100 for name, _ in members}) for members in one.values()]
    assert sum(n > 1 for n in mixed) >= 10


def test_a_failed_write_leaves_no_temporary_file(tmp_path):
    from poolsift.sources.storage import atomic_output

    with pytest.raises(KeyError), atomic_output(str(tmp_path / "x")) as out:
        out.write(b"half")
        raise KeyError
    shard = tars.ShardFile(str(tmp_path), "y.tar")
    shard.leave(ValueError("no"))
    assert list(tmp_path.iterdir()) == []


# -- the rest -----------------------------------------------------------------


def test_vector_archives(spark, tmp_path):
    for stem, n in (("x", 5), ("y", 0), ("z", 5000)):
        np.savez(tmp_path / f"{stem}.npz", l14_img=np.arange(n * 3).reshape(n, 3).astype(np.float16), b32_img=np.ones((n, 2)))
    rows = vector_files.read_npz(spark, str(tmp_path)).collect()
    assert len(rows) == 5005
    got = {(r.file_stem, r.row_idx): r.vec for r in rows}
    assert got["x", 4] == [12.0, 13.0, 14.0] and ("z", 4999) in got
    assert vector_files.read_npz(spark, str(tmp_path), "b32_img").first().vec == [1.0, 1.0]
    pool = spark.createDataFrame([("u1",), ("u2",)], "uid string").coalesce(1)
    pool.write.parquet(str(tmp_path / "pool"))
    scanned = tables.scan_pool_positions(spark, str(tmp_path / "pool"), ["uid"])
    assert sorted((r.row_idx, r.uid) for r in scanned.collect()) == [(0, "u1"), (1, "u2")]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_vectors_of_the_rows_that_are_left(spark, tmp_path, save):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        folder = tmp_path / "with blank"
        folder.mkdir()
        for stem, n in (("a", 7000), ("b", 1), ("c", 300)):
            ids = np.arange(n) + (ord(stem) - 96) * 100_000
            pq.write_table(pa.table({"uid": ids, "text": [f"{stem} {i}" for i in range(n)]}), folder / f"{stem}.parquet", row_group_size=500)
            save(folder / f"{stem}.npz", l14_img=np.stack([ids, -ids, np.ones(n)], 1).astype(np.float32))
        rows = curation.pool_with_vectors(spark, str(folder), ["uid"], keep=lambda df: df.where("uid % 7 = 3 OR uid % 1000 = 5"))
        got = {r.uid: r.vec for r in rows.collect()}
        want = [i for stem, n in (("a", 7000), ("b", 1), ("c", 300)) for i in np.arange(n) + (ord(stem) - 96) * 100_000 if i % 7 == 3 or i % 1000 == 5]
        assert got == {i: [float(i), float(-i), 1.0] for i in want}
        assert rows.rdd.getNumPartitions() > 3
        # rows in any order, columns of any name
        mixed = curation.pool_positions(spark, str(folder), ["uid"]).repartition(5).withColumn("vec", F.lit(1))
        assert {r.uid: r.vec[0] for r in vector_files.attach_vectors(mixed).collect()} == {r.uid: float(r.uid) for r in mixed.collect()}
        assert vector_files.attach_vectors(mixed.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranges_of_one_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_files, "RANGE_BYTES", 4000)
    matrix = np.arange(30_000, dtype=np.float32).reshape(10_000, 3)
    np.savez(tmp_path / "big.npz", l14_img=matrix)
    rows = vector_files.read_npz(spark, str(tmp_path))
    assert {r.row_idx: r.vec for r in rows.collect()} == dict(enumerate(matrix.tolist()))
    archive = vector_files.VectorFile(str(tmp_path / "big.npz"), "l14_img")
    assert archive.pick(np.array([0, 9_999])).tolist() == matrix[[0, 9_999]].tolist()
    with pytest.raises(ValueError):
        archive.rows(9_999, 10_001)
    np.savez(tmp_path / "flat.npz", l14_img=np.zeros(3))
    with pytest.raises(ValueError, match="one row per vector"):
        vector_files.VectorFile(str(tmp_path / "flat.npz"), "l14_img")


def test_archives_written_next_to_their_rows(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS uid", "array(cast(id AS float), 0.5f) AS vec").repartition(3)
    files = vector_files.write_with_vectors(rows, str(tmp_path), half=True)
    assert files.agg(F.sum("rows")).first()[0] == 50
    back = curation.pool_with_vectors(spark, str(tmp_path), ["uid"])
    assert {r.uid: r.vec for r in back.collect()} == {i: [float(i), 0.5] for i in range(50)}
    with pytest.raises(Exception, match="needs a vector"):
        vector_files.write_with_vectors(rows.withColumn("vec", F.expr("if(uid = 3, null, vec)")), str(tmp_path / "x"))


def test_language_plugin(spark):
    df = spark.createDataFrame([("a\nb",), (None,), ("zz",)], "text string")
    detected = vector_files.detect_language(df, lambda: lambda lines: ["en" if t == "a b" else "xx" for t in lines])
    assert [r.lang for r in detected.collect()] == ["en", None, "xx"]
    doubled = vector_files.embed_with(df.fillna(""), lambda frames: (f.assign(text=f.text * 2) for f in frames), "text string")
    assert [r.text for r in doubled.collect()] == ["a\nba\nb", "", "zzzz"]


def test_images_and_sidecars(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.JPG": b"12345", "sub/b.webp": b"1", "c.gif": b"1", "a.txt": "  né ".encode(), "sub/b.txt": "né".encode("latin-1")}.items():
        (tmp_path / name).write_bytes(data)
    listing = images.image_listing(spark, str(tmp_path), max_bytes=4).collect()
    assert {(r.stem, r.status) for r in listing} == {("a", "too_large"), ("b", "ok")}
    texts = {os.path.basename(r.path): r.alt_text for r in images.read_sidecars(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "né", "b.txt": "né"}
    files = audit.checksums(spark, str(tmp_path))
    manifest = files.select("path", "size", F.upper("sha256").alias("sha256")).filter("path NOT LIKE '%gif'")
    broken = manifest.withColumn("sha256", F.when(F.col("path").endswith("a.JPG"), "00").otherwise(F.col("sha256")))
    status = {os.path.basename(r.path): r.status for r in audit.audit_files(files, broken).collect()}
    assert status == {"a.JPG": "hash_mismatch", "b.webp": "ok", "c.gif": "unexpected", "a.txt": "ok", "b.txt": "ok"}
    sizes = {os.path.basename(r.dir): (r.files, r.bytes) for r in audit.folder_sizes(files).collect()}
    assert sizes["sub"] == (2, 1 + 2)


def test_small_tables(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" car \n\nbus\n")
    assert [r.value for r in tables.read_lines(spark, str(tmp_path / "w.txt")).collect()] == ["car", "bus"]
    (tmp_path / "e.txt").write_text("n01440764\nn00000017\n")
    assert [r[0] for r in tables.read_entity_ids(spark, str(tmp_path / "e.txt")).collect()] == [1440764, 17]
    (tmp_path / "sizes.json").write_text('{"0.tar": 5, "1.tar": 7}')
    assert {tuple(r) for r in tables.read_cached_sizes(spark, str(tmp_path / "sizes.json")).collect()} == {("0.tar", 5), ("1.tar", 7)}
    (tmp_path / "0_stats.json").write_text('{"successes": 3, "other": 1}')
    (tmp_path / "9_stats.json").write_text('{"successes": 3}')
    (tmp_path / "0.tar").write_bytes(b"x")
    assert [tuple(r) for r in tables.read_shard_sidecars(spark, str(tmp_path)).collect()] == [("0.tar", 3)]
    (tmp_path / "tasks.yml").write_text("a/b:\n  name: B\n  size: 3\n  main_metric: null\n  tags: [t]\nc: {}\n")
    tasks = {r.key: r for r in tables.read_tasks(spark, str(tmp_path / "tasks.yml")).collect()}
    assert tasks["a/b"].name == "B" and tasks["a/b"].main_metric is None and tasks["c"].main_metric == "acc1"
    with pytest.raises(ValueError):
        spark.createDataFrame([("u",)], "uid string").write.parquet(str(tmp_path / "pool"))
        tables.scan_pool(spark, str(tmp_path / "pool"), ["uid", "text"])


def test_results_are_appended_and_ordered(spark, tmp_path):
    from poolsift.operators.metrics.rollup import latest_results

    folder = str(tmp_path / "results")
    for value in (0.1, 0.2):
        row = spark.createDataFrame([("k", "A", {"acc1": value, "acc5": None})], "key string, dataset string, metrics map<string,double>")
        tables.append_results(row, folder)
    back = tables.read_results(spark, folder)
    assert back.count() == 2
    assert latest_results(back).first().metrics["acc1"] == 0.2


def test_csv_keeps_awkward_captions(spark, tmp_path):
    rows = [('say "hi", \\ there', 1.0), ("two\nlines", 2.0), ("", 3.0), ("ünï", 4.0)]
    df = spark.createDataFrame(rows, "text string, s double")
    tables.write_csv(df, str(tmp_path / "c"))
    for size in (None, 7, 1):
        back = csv_files.read_csv(spark, str(tmp_path / "c"), df.schema, size)
        assert sorted((r.text or "", r.s) for r in back.collect()) == sorted(rows)


def plain_records(raw):
    """Records of a file, character by character."""
    out, held, start, inside, taken = [], bytearray(), 0, False, False
    for i, c in enumerate(raw):
        if c == 10 and not inside and not taken:
            out.append((start, bytes(held)))
            held, start = bytearray(), i + 1
            continue
        inside ^= c == 34 and not taken
        taken = c == 92 and not taken
        held.append(c)
    if held:
        out.append((start, bytes(held)))
    return [(at, r[:-1] if r.endswith(b"\r") else r) for at, r in out if r not in (b"", b"\r")]


def test_csv_records_whatever_the_ranges(spark, tmp_path):
    rng = np.random.default_rng(6)
    for i in range(4):
        raw = bytes(rng.choice(np.frombuffer(b'ab"\\\n\r,', np.uint8), 300, p=[0.2, 0.2, 0.15, 0.15, 0.15, 0.05, 0.1]).tolist())
        (tmp_path / f"{i}.csv").write_bytes(raw)
    (tmp_path / "empty.csv").write_bytes(b"")
    want = sorted((f"{i}.csv", at, r.decode()) for i in range(4) for at, r in plain_records((tmp_path / f"{i}.csv").read_bytes()))
    for size in (1000, 64, 5, 1):
        got = csv_files.read_records(spark, str(tmp_path), size).collect()
        assert sorted((os.path.basename(r.path), r.place, r.record) for r in got) == want


def test_a_range_reads_little_behind_its_end(monkeypatch, tmp_path):
    raw = b'"0123456789","x"\n' * 400_000  # 6.8 MB
    (tmp_path / "x.csv").write_bytes(raw)
    scanned = []
    whole = csv_files.scan
    monkeypatch.setattr(csv_files, "scan", lambda data, *state: scanned.append(len(data)) or whole(data, *state))
    step = 1 << 16
    records = []
    for low in range(0, 10 * step, step):
        records += csv_files._records(str(tmp_path / "x.csv"), low, low + step, raw[:low].count(b'"') % 2, len(raw))
    assert [at for at, _ in records] == list(range(0, 10 * step + 1, 17))
    assert sum(scanned) < 2 * 10 * step
    # the state behind a range is followed once, or twice over its first read
    scanned.clear()
    assert csv_files._effect(str(tmp_path / "x.csv"), 0, 17 * 400_000) == [0, 1, 1, 0]
    assert sum(scanned) < 3 * len(raw)


def test_malformed_csv_comes_out_with_its_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,"a\nb"\ntwo,"c"\n3,"d",extra\n4\n5,"e"\n')
    columns = tables.T.StructType([tables.T.StructField("id", tables.T.LongType()), tables.T.StructField("text", tables.T.StringType())])
    for size in (None, 4):
        assert sorted(tuple(r) for r in csv_files.read_csv(spark, str(tmp_path), columns, size).collect()) == [(1, "a\nb"), (5, "e")]
        bad = csv_files.rejected(spark, str(tmp_path), columns, size).orderBy("place").collect()
        assert [(r.place, r.record) for r in bad] == [(16, 'two,"c"'), (24, '3,"d",extra'), (36, "4")]


def test_checksums_of_files_over_two_gigabytes(spark, tmp_path):
    import hashlib

    with open(tmp_path / "large", "wb") as file:
        file.truncate(3 << 30)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "none").write_bytes(b"")
    got = {os.path.basename(r.path): (r.size, r.sha256) for r in audit.checksums(spark, str(tmp_path)).collect()}
    sha = hashlib.sha256()
    for _ in range(3 << 6):
        sha.update(bytes(1 << 24))
    assert got == {"large": (3 << 30, sha.hexdigest()), "small": (3, hashlib.sha256(b"abc").hexdigest()), "none": (0, hashlib.sha256(b"").hexdigest())}


def test_tree_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"0123456789")
    (tmp_path / "b").write_bytes(b"")
    digest = lambda *parts: hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    got = {os.path.basename(r.path): r.tree_sha256 for r in audit.tree_checksums(spark, str(tmp_path), range_bytes=4).collect()}
    assert got == {"a": digest(b"0123", b"4567", b"89"), "b": digest(b"")}


def test_joined_shards_are_one_folder_each(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "shard string, v int").repartition(3)
    tables.write_joined_shards(df, str(tmp_path / "j"))
    assert sorted(d for d in os.listdir(tmp_path / "j") if "=" in d) == ["shard=a", "shard=b"]
    assert spark.read.parquet(str(tmp_path / "j")).count() == 3
    both = tables.scan_pool(spark, f"{tmp_path}/j/shard=a::{tmp_path}/j/shard=b", ["v"])
    assert sorted(r.v for r in both.collect()) == [1, 2, 3]


def test_bad_shard_gives_an_error_row(spark, tmp_path):
    write_tar(tmp_path / "00000003.tar", sample("a"))
    (tmp_path / "00000005.tar").write_bytes(b"no archive" * 100)
    good, bad = tars.read_samples(spark, str(tmp_path)).orderBy("shard").collect()
    assert good.key == "a" and good.error is None
    assert bad.key is None and bad.members is None and bad.error


def test_shard_range_of_an_index(spark, tmp_path):
    for number in range(5):
        write_tar(tmp_path / f"{number:08d}.tar", sample("abcde"[number]))
    found = tars.index_samples(spark, str(tmp_path), 1, 3).collect()
    assert sorted(r.shard for r in found) == ["00000001.tar", "00000002.tar", "00000003.tar"]
    subset = spark.createDataFrame([("a" * 32,), ("c" * 32,)], "uid string")
    for known in (None, tars.index_samples(spark, str(tmp_path))):
        report = reshard(spark, str(tmp_path), subset, str(tmp_path / f"out{known is None}"), index=known, first_shard=2)
        assert (report.processed_count, report.output_count) == (3, 1)


def test_metadata_and_vectors_of_different_length_end_the_job(spark, tmp_path):
    spark.range(3).selectExpr("id AS uid").coalesce(1).write.parquet(str(tmp_path / "raw"))
    (source,) = (tmp_path / "raw").glob("part-*.parquet")
    pool = tmp_path / "pool"
    pool.mkdir()
    (pool / "a.parquet").write_bytes(source.read_bytes())
    np.savez(pool / "a.npz", l14_img=np.zeros((3, 2), np.float16))
    assert curation.pool_with_vectors(spark, str(pool), ["uid"]).count() == 3
    np.savez(pool / "a.npz", l14_img=np.zeros((2, 2), np.float16))
    with pytest.raises(ValueError, match="a: 3 rows, 2 vectors"):
        curation.pool_with_vectors(spark, str(pool), ["uid"])
