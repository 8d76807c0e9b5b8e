"""Readers and writers of the engine's artefacts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright import schemas
from lorewright.functions import text as T

#: A GraphML file's keys, with what they belong to, and the lines around its nodes and edges. Fixed values.
GRAPHML_KEYS = (("d0", "node", "entity_type", "string"), ("d1", "node", "description", "string"), ("d2", "node", "source_id", "string"), ("d3", "edge", "weight", "double"), ("d4", "edge", "description", "string"), ("d5", "edge", "source_id", "string"), ("d6", "edge", "order", "long"))
GRAPHML_HEAD = [
    "<?xml version='1.0' encoding='utf-8'?>",
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    *(f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in GRAPHML_KEYS),
    '<graph edgedefault="undirected">',
]
GRAPHML_END = ["</graph>", "</graphml>"]
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".webm")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path and value of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _entries(df: DataFrame, value: str, kind: str, key: str, ordinal: str) -> DataFrame:
    others = [c for c in df.columns if c != value]
    return df.select(*others, F.posexplode(F.map_entries(F.from_json(value, f"map<string,{kind}>"))).alias(ordinal, "e")).select(*others, ordinal, F.col("e.key").alias(key), F.col("e.value").alias("v"))


def json_map(spark: SparkSession, path: str, kind: str, key: str = "key") -> DataFrame:
    """Rows (path, ord, key, v) of one-level JSON objects in file order (SRC1). kind: the values' type."""
    return _entries(whole(spark, path), "value", kind, key, "ord")


def json_map2(spark: SparkSession, path: str, kind: str, outer: str = "video_name", inner: str = "key") -> DataFrame:
    """Rows (path, outer, ord, inner, v) of two-level JSON objects (SRC1)."""
    rows = _entries(whole(spark, path), "value", "string", outer, "outer_ord").withColumnRenamed("v", "value")
    return _entries(rows, "value", kind, inner, "ord").drop("outer_ord")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    rows = json_map2(spark, path, "struct<time:string,content:string,transcript:string,frame_times:array<double>>", inner="segment_idx")
    return rows.select("video_name", F.col("ord").cast("int").alias("seg_ord"), "segment_idx", "v.*")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    fields = "frame_path:string,segment_idx:string,segment_name:string,frame_idx:int,game:string,entities:array<string>,transcript:string,vlm_output:string,main_champ:string,partners:array<string>"
    return json_map2(spark, path, f"struct<{fields}>", inner="frame_key").select("video_name", "frame_key", "v.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of one-level files; segment references may be a string or a list."""
    kind = "struct<tokens:bigint,content:string,chunk_order_index:bigint,video_segment_id:string,sanitized:boolean>"
    rows = json_map(spark, path, kind, "chunk_id")
    refs = F.when(F.col("v.video_segment_id").startswith("["), F.from_json("v.video_segment_id", "array<string>")).otherwise(F.array("v.video_segment_id"))
    return rows.select("path", "chunk_id", F.col("ord").alias("chunk_ord"), "v.tokens", "v.content", "v.chunk_order_index", refs.alias("video_segment_id"), "v.sanitized")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a vector file: its dimension and data (SRC5)."""
    parsed = F.from_json("value", "struct<embedding_dim:int,data:array<struct<__id__:string,entity_name:string,__vector__:array<float>>>>")
    rows = whole(spark, path).select("path", parsed.alias("f")).select("path", "f.embedding_dim", F.explode("f.data").alias("d"))
    return rows.select("path", "embedding_dim", F.col("d.__id__").alias("id"), "d.entity_name", F.col("d.__vector__").alias("vector"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A namespace as Parquet by video (SRC2, D1). Only the partitions written are replaced."""
    writer = df.write.mode(mode)
    (writer.partitionBy("video_name").option("partitionOverwriteMode", "dynamic") if "video_name" in df.columns else writer).parquet(path)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """A namespace as one JSON object per video, for export (SRC2). A video's rows meet in one row."""
    others = [c for c in df.columns if c not in (key, "video_name")]
    entry = F.struct(F.col(key).alias("key"), F.struct(*others).alias("value"))
    return df.groupBy("video_name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """SRC11: the quarantine log."""
    df.write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str, fields: str = schemas.EVALUATION) -> DataFrame:
    """Evaluation cases of a JSON list, or of an object with a list of cases (SRC12, D20)."""
    kind = f"array<struct<{','.join(f.strip().replace(' ', ':', 1) for f in fields.split(', '))}>>"
    listed = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<cases:{kind}>")["cases"])
    return whole(spark, path).select(F.posexplode(listed).alias("ord", "c")).select("ord", "c.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """video_name and url of a registry; entries without a URL are left out (SRC13)."""
    return json_map(spark, path, "struct<url:string>", "video_name").where(T.strip(F.coalesce("v.url", F.lit(""))) != "").select("video_name", T.strip(F.col("v.url")).alias("url"))


def read_specification(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """An alias specification {canonical: [alias]}, a configuration of bounded size (D16)."""
    return {r["canonical"]: list(r["v"] or []) for r in json_map(spark, path, "array<string>", "canonical").collect()}


def write_leaderboard(df: DataFrame, path: str) -> None:
    """SRC14."""
    df.write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, folder, bytes of the files under a folder, without their contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder"), "bytes")


def find_videos(files: DataFrame) -> DataFrame:
    """Files with a video's extension, sorted (SRC9)."""
    return files.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*VIDEO_EXTENSIONS)).orderBy("name")


def find_folders(files: DataFrame, marker: str, done: DataFrame) -> DataFrame:
    """Folders that hold the marker file and aren't done yet, sorted; the first is next (SRC8, JN9)."""
    return files.where(F.col("name") == marker).select("folder").distinct().join(done.select("folder"), "folder", "left_anti").orderBy("folder")


def complete_folders(files: DataFrame, required: tuple[str, ...] = schemas.REQUIRED_EXTRACTION) -> DataFrame:
    """folder and whether it has all required files (SRC10)."""
    return files.groupBy("folder").agg((F.count_distinct(F.when(F.col("name").isin(*required), F.col("name"))) == len(required)).alias("complete"))


def check_assets(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, need, ok of a manifest (path, need: required or recommended, kind: file or dir): whether the listing has it (SRC15)."""
    there = files.select("path", F.lit("file").alias("kind")).union(files.select(F.regexp_replace("path", "/[^/]*$", ""), F.lit("dir"))).distinct().withColumn("there", F.lit(True))
    return manifest.join(there, ["path", "kind"], "left").select("path", "need", F.coalesce("there", F.lit(False)).alias("ok"))


def guarded(path: str, root: str) -> str:
    """path, if it is inside root (SRC16)."""
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    inside = [p for p in root.split("/") if p not in ("", ".")]
    if parts[: len(inside)] != inside:
        raise ValueError(f"{path} is outside {root}")
    return path


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files with their attributes by name (SRC3).

    Rows of the XML source are elements, so a file may be read by many tasks; the file's keys are its small dictionary.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    data = "array<struct<_VALUE:string,_key:string>>"
    keys = read("key", "_id string, `_attr.name` string, _for string")
    names = {(r[2], r[0]): r[1] for r in keys.collect()}  # a handful for each file

    def attributes(rows: DataFrame, kind: str, wanted: list[str]) -> DataFrame:
        value = lambda name: F.get(F.filter("data", lambda d: d["_key"].isin([k for (f, k), n in names.items() if f == kind and n == name] or [""])), F.lit(0))["_VALUE"]
        return rows.select(*[c for c in rows.columns if c != "data"], *[value(n).alias(n) for n in wanted])

    nodes = read("node", f"_id string, data {data}").withColumn("node_ord", F.monotonically_increasing_id())
    edges = read("edge", f"_source string, _target string, data {data}").withColumn("edge_ord", F.monotonically_increasing_id())
    nodes = attributes(nodes, "node", ["entity_type", "description", "source_id"]).withColumnRenamed("_id", "id")
    edges = attributes(edges, "edge", ["weight", "description", "source_id", "order"]).withColumnsRenamed({"_source": "src", "_target": "dst"})
    return nodes, edges.withColumns({"weight": F.col("weight").try_cast("double"), "order": F.col("order").try_cast("long")})


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as GraphML files, a whole one for each partition of its nodes and of its edges (SRC4)."""
    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_line = False
        for batch in batches:
            if batch.num_rows and not any_line:
                any_line = True
                yield pa.record_batch([pa.array(GRAPHML_HEAD)], ["value"])
            yield pa.record_batch([batch.column(0)], ["value"])
        if any_line:
            yield pa.record_batch([pa.array(GRAPHML_END)], ["value"])

    for part, name in ((1, "nodes"), (2, "edges")):
        _graphml_lines(nodes, edges, part).mapInArrow(wrap, "value string").write.text(f"{path}/{name}")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of one GraphML file in order (SRC4): line and at. Written as one text file where a single file is wanted."""
    spark = nodes.sparkSession
    fixed = lambda at, lines: spark.createDataFrame([(at, str(k).zfill(4), line) for k, line in enumerate(lines)], "part int, at string, line string")
    n, e = (_graphml_lines(nodes, edges, part, placed=True) for part in (1, 2))
    return fixed(0, GRAPHML_HEAD).union(n).union(e).union(fixed(3, GRAPHML_END)).orderBy("part", "at")


def _graphml_lines(nodes: DataFrame, edges: DataFrame, part: int, placed: bool = False) -> DataFrame:
    """Lines of a graph's nodes (part 1) or edges (part 2); placed: with part and at."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cell = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), esc(c), F.lit("</data>"))
    if part == 1:
        rows = nodes.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.concat(F.lit('<node id="'), esc("id"), F.lit('">'), cell("d0", "entity_type"), cell("d1", "description"), cell("d2", "source_id"), F.lit("</node>")).alias("line"))
    else:
        rows = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst").alias("at"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('">'), cell("d3", "weight"), cell("d4", "description"), cell("d5", "source_id"), cell("d6", "order"), F.lit("</edge>")).alias("line"))
    return rows if placed else rows.select("line")


def image_index(spark: SparkSession, folder: str, embed) -> DataFrame:
    """Image vectors by name, category and file of a folder tree name/category/file (SRC17)."""
    from lorewright.hooks import arrow_files

    found = arrow_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), embed)
    part = lambda k: F.substring_index(F.substring_index("path", "/", -k), "/", 1)
    return found.select(F.concat_ws("_", part(3), part(2), part(1)).alias("id"), part(3).alias("name"), part(2).alias("category"), part(1).alias("filename"), "vector")


#: Matches that a task takes on average, so that its memory doesn't grow with their number.
TASK_MATCHES = 200_000


def best_regions(matches: DataFrame, partners: int = 4) -> DataFrame:
    """A frame's main name (the best score in the middle) and partners (the first distinct names by score) (TK8). matches: frame_key, region, name, score.

    The rows are dealt once, by frame, to as many tasks as their number asks for; a name's best score is found before names are ranked.
    """
    dealt = matches.repartition(max(1, math.ceil(matches.count() / TASK_MATCHES)), "frame_key")
    best = dealt.groupBy("frame_key", "region", "name").agg(F.max("score").alias("score"))
    firsts = best.withColumn("k", F.row_number().over(Window.partitionBy("frame_key", "region").orderBy(F.desc("score"), "name"))).where(F.col("k") <= max(partners, 1))
    main = F.max(F.when((F.col("region") == "middle") & (F.col("k") == 1), F.col("name")))
    others = F.transform(F.array_sort(F.collect_list(F.when((F.col("region") == "partners") & (F.col("k") <= partners), F.struct("k", "name")))), lambda x: x["name"])
    rows = firsts.groupBy("frame_key").agg(F.coalesce(main, F.lit("Unknown")).alias("main"), others.alias("partners"))
    return rows.withColumn("entities", F.array_distinct(F.concat(F.when(F.col("main") != "Unknown", F.array("main")).otherwise(F.array().cast("array<string>")), "partners")))
