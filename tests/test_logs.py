"""The commit log, the failure policy and the data source, with failures in the middle."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lorewright import hooks
from lorewright.sources import artefacts, log, tables


@pytest.fixture
def stream_folder(spark, tmp_path):
    def add(name, ids):
        spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    return str(tmp_path), add


def run_stream(spark, root, table):
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    log.ingest_once(stream, table, "id", f"{root}/checkpoint").awaitTermination()


@pytest.mark.parametrize("where", ["before the commit", "after the commit", "between rows and keys"])
def test_exactly_once(spark, stream_folder, monkeypatch, where):
    """A batch that fails and is replayed leaves neither gap nor double, wherever it failed."""
    root, add = stream_folder
    table = log.LoggedTable(spark, f"{root}/table")
    add("a", range(0, 10))
    run_stream(spark, root, table)
    add("b", range(5, 20))
    commit, dies = log.LoggedTable._commit, [True]

    def failing(self, number, folder):
        if dies:
            dies.clear()
            if where == "after the commit":
                commit(self, number, folder)
            if where == "between rows and keys":
                _, at, fs = self._fs()
                fs.delete(at(f"{folder}/keys"), True)
            raise OSError("lost")
        return commit(self, number, folder)

    monkeypatch.setattr(log.LoggedTable, "_commit", failing)
    with pytest.raises(Exception, match="lost"):
        run_stream(spark, root, table)
    assert table.read().count() == (20 if where == "after the commit" else 10)
    run_stream(spark, root, table)
    add("c", range(15, 25))
    run_stream(spark, root, table)
    assert sorted(r["id"] for r in table.read().collect()) == list(range(25))
    assert sorted(r["id"] for r in table.keys().collect()) == list(range(25))
    assert table.vacuum() == (0 if where == "after the commit" else 1) and table.read().count() == 25


def test_one_of_two_commits_wins(spark, tmp_path):
    table = log.LoggedTable(spark, f"{tmp_path}/t")
    assert table.read() is None and table.append(spark.range(3), 0) and not table.append(spark.range(5), 0)
    assert table._commit(0, "other") is False and table.read().count() == 3


def test_failure_policy(spark, tmp_path):
    """Rows fail alone; a retry takes failed ones only, as often as allowed; stopping keeps what was done."""

    def moody(prompts):
        for p in prompts:
            if p.endswith(("0", "5")):
                raise ValueError("no " + p[-1])
        return [p + "!" for p in prompts]

    rows = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    status = log.LoggedTable(spark, f"{tmp_path}/status")
    found = hooks.run_with_status(rows, "id", "prompt", moody, status, retries=1)
    counts = {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
    assert counts == {"done": 32, "failed": 8}
    assert {r["raw"] for r in found.where("state = 'done'").collect()} == {f"p{i}!" for i in range(40) if i % 5}
    assert {r["error"] for r in found.where("state = 'failed'").collect()} == {"ValueError: no 0", "ValueError: no 5"}
    again = hooks.outcome(hooks.run_with_status(rows, "id", "prompt", lambda ps: [p + "?" if not p.endswith("0") else 1 / 0 for p in ps], status, retries=1), "id").collect()
    assert sorted((r["attempts"], r["state"]) for r in again) == sorted([(1, "done")] * 32 + [(2, "done")] * 4 + [(2, "failed")] * 4)
    before = status.read().count()
    hooks.run_with_status(rows, "id", "prompt", moody, status, retries=1)
    assert status.read().count() == before == 48
    stopped = log.LoggedTable(spark, f"{tmp_path}/stopped")
    with pytest.raises(hooks.FailedRows, match="8 rows"):
        hooks.run_with_status(rows, "id", "prompt", moody, stopped, continue_on_error=False)
    assert stopped.read().where("state = 'done'").count() == 32


def sample_tables(spark):
    segments = spark.createDataFrame([("v1", "0", "0-30", "c é", "t"), ("v1", "1", "30-60", "", None), ("v2", "0", "0-30", "x", "y")], artefacts.TABLES["segments"][0])
    chunks = spark.createDataFrame([("v1", "chunk-a", 3, "one", 0, ["v1_0", "v1_1"]), ("v2", "chunk-b", None, "two", 0, [])], artefacts.TABLES["chunks"][0])
    vectors = spark.createDataFrame([("v1", "a", "E", [0.5, -1.0]), ("v2", "b", None, [2.0, 0.25])], artefacts.TABLES["vectors"][0])
    nodes = spark.createDataFrame([("v1", "N <1>", "GEO", 'a & "b"', "c1<SEP>c2"), ("v2", "M", None, "", "c")], artefacts.TABLES["nodes"][0])
    edges = spark.createDataFrame([("v1", "N <1>", "M", 2.5, "d", "c1"), ("v2", "M", "O", None, None, "c")], artefacts.TABLES["edges"][0])
    return {"segments": segments, "chunks": chunks, "vectors": vectors, "nodes": nodes, "edges": edges}


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_source_round_trip_and_filters(spark, tmp_path):
    artefacts.register(spark)
    root = str(tmp_path / "root")
    wanted = sample_tables(spark)
    for table, df in wanted.items():
        df.write.format("lorewright").option("table", table).mode("append").save(root)
    for table, df in wanted.items():
        back = spark.read.format("lorewright").option("table", table).load(root)
        assert rows_of(back) == rows_of(df)
        files = [f for v in ("v1", "v2") for f in os.listdir(f"{root}/{v}") if f.endswith(artefacts.TABLES[table][1])]
        assert table in ("nodes", "edges") or back.rdd.getNumPartitions() == len(files)
        one = back.where("video_name = 'v2'")
        assert one.rdd.getNumPartitions() == 1 and rows_of(one) == rows_of(df.where("video_name = 'v2'"))
    reader = artefacts.ArtefactReader(root, "segments")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = GreaterThan(("time",), "a")
    assert list(reader.pushFilters([EqualTo(("video_name",), "v1"), left])) == [left] and {p.video for p in reader.partitions()} == {"v1"}


def test_source_reads_what_the_other_readers_read(spark, tmp_path):
    """Folders that this engine or another wrote without manifests."""
    artefacts.register(spark)
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "kv_store_video_segments.json").write_text(json.dumps({"v1": {"0": {"time": "0-30", "content": "c", "transcript": "t", "frame_times": [1.0]}}}))
    (tmp_path / "v1" / "vdb_chunks.json").write_text(json.dumps({"embedding_dim": 2, "data": [{"__id__": "a", "__vector__": [0.5, 1.0]}]}))
    read = lambda t: spark.read.format("lorewright").option("table", t).load(str(tmp_path))
    other = tables.read_segments(spark, str(tmp_path / "v1" / "kv_store_video_segments.json")).select(*read("segments").columns)
    assert rows_of(read("segments")) == rows_of(other)
    assert [(r["id"], r["vector"]) for r in read("vectors").collect()] == [(r["id"], r["vector"]) for r in tables.read_vectors(spark, str(tmp_path / "v1" / "vdb_chunks.json")).collect()]
    assert read("nodes").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    artefacts.register(spark)
    root = str(tmp_path / "root")
    good = sample_tables(spark)["segments"]
    good.write.format("lorewright").mode("append").save(root)
    bad = good.select(F.when(F.col("video_name") == "v2", "../x").otherwise("v3").alias("video_name"), *good.columns[1:]).repartition(1, "video_name")
    with pytest.raises(Exception, match="can't be a folder"):
        bad.union(good.withColumn("video_name", F.lit("v4"))).write.format("lorewright").mode("append").save(root)
    assert rows_of(spark.read.format("lorewright").load(root)) == rows_of(good)
    left = {f for _, _, files in os.walk(root) for f in files if "segments" in f}
    assert len(left) <= 3 and not any(os.listdir(f"{root}/{v}") for v in ("v3", "v4") if os.path.isdir(f"{root}/{v}"))
