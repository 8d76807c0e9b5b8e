"""The engine's artefact folders as a Spark data source: spark.read.format("lorewright") (U5, SRC1, SRC3, SRC5).

A root holds a folder for each video with its JSON stores, vector file and graph. Each file is a partition of the
reader, so that a large video is read by many tasks, and filters on video_name choose folders before any file is opened. Files are reached through pyarrow's file systems, so
a root may be a path or any URI that these know. Options: path (the root), table (segments, chunks, vectors, nodes, edges).

The writer stages a file for each video and task; its commit writes one manifest that names them, by a rename, and readers
of a root that has manifests take only what these name. A write that fails removes what it staged and leaves no manifest,
so that nothing of it is ever read. Rows of one task and video are held until their file is written.
"""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Each table's columns and the file that holds it. Fixed values.
TABLES = {
    "segments": ("video_name string, segment_idx string, time string, content string, transcript string", "kv_store_video_segments.json"),
    "chunks": ("video_name string, chunk_id string, tokens long, content string, chunk_order_index long, video_segment_id array<string>", "kv_store_text_chunks.json"),
    "vectors": ("video_name string, id string, entity_name string, vector array<float>", "vdb_chunks.json"),
    "nodes": ("video_name string, id string, entity_type string, description string, source_id string", "graph_chunk_entity_relation.graphml"),
    "edges": ("video_name string, src string, dst string, weight double, description string, source_id string", "graph_chunk_entity_relation.graphml"),
}
MANIFESTS = "_manifests"
GRAPHML = "{http://graphml.graphdrawing.org/xmlns}"


def _fs(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _read_bytes(system, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _rows(table: str, video: str, raw: bytes) -> Iterator[tuple]:
    """A file's rows in the table's columns."""
    if table in ("nodes", "edges"):
        tree = ElementTree.fromstring(raw)
        names = {k.get("id"): k.get("attr.name") for k in tree.iter(f"{GRAPHML}key")}
        for element in tree.iter(f"{GRAPHML}{table[:-1]}"):
            data = {names.get(d.get("key")): d.text or "" for d in element.iter(f"{GRAPHML}data")}
            if table == "nodes":
                yield video, element.get("id"), data.get("entity_type"), data.get("description"), data.get("source_id")
            else:
                yield video, element.get("source"), element.get("target"), float(data["weight"]) if "weight" in data else None, data.get("description"), data.get("source_id")
        return
    held = json.loads(raw)
    if table == "vectors":
        for x in held["data"]:
            yield video, x["__id__"], x.get("entity_name"), [float(v) for v in x["__vector__"]]
    elif table == "chunks":
        for key, x in held.items():
            ids = x.get("video_segment_id")
            yield video, key, x.get("tokens"), x.get("content"), x.get("chunk_order_index"), ids if isinstance(ids, list) or ids is None else [ids]
    else:
        inner = held.get(video, held)
        for key, x in inner.items():
            yield video, key, x.get("time"), x.get("content"), x.get("transcript")


@dataclass
class Artefact(InputPartition):
    video: str
    file: str


@dataclass
class Staged(WriterCommitMessage):
    files: list


class ArtefactReader(DataSourceReader):
    def __init__(self, root: str, table: str):
        self.root, self.table, self.videos = root, table, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the video's name; the rest stay Spark's."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("video_name",) else set(f.value) if isinstance(f, In) and f.attribute == ("video_name",) else None
            if wanted is None:
                yield f
            else:
                self.videos = wanted if self.videos is None else self.videos & wanted

    def partitions(self) -> list[Artefact]:
        from pyarrow import fs

        system, root = _fs(self.root)
        listed: dict[str, list[str]] = {}
        manifests = system.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
        if manifests:
            for m in sorted(manifests, key=lambda m: m.base_name):
                if m.base_name.endswith(".json"):
                    for table, video, file in json.loads(_read_bytes(system, m.path)):
                        if table == self.table:
                            listed.setdefault(video, []).append(file)
        else:
            name = TABLES[self.table][1]
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.Directory and system.get_file_info(f"{info.path}/{name}").type == fs.FileType.File:
                    listed[info.base_name] = [f"{info.base_name}/{name}"]
        return [Artefact(v, f) for v, files in sorted(listed.items()) if self.videos is None or v in self.videos for f in files] or [Artefact("", "")]

    def read(self, partition: Artefact) -> Iterator[tuple]:
        system, root = _fs(self.root)
        if partition.file:
            yield from _rows(self.table, partition.video, _read_bytes(system, f"{root}/{partition.file}"))


def _rendered(table: str, video: str, rows: list[Row]) -> bytes:
    """A file of the rows, as the engine's other readers expect it."""
    if table in ("nodes", "edges"):
        root = ElementTree.Element(f"{GRAPHML}graphml")
        fields = [f for f in ("entity_type", "weight", "description", "source_id") if f in rows[0]]
        for k, f in enumerate(fields):
            ElementTree.SubElement(root, f"{GRAPHML}key", {"id": f"d{k}", "for": table[:-1], "attr.name": f, "attr.type": "double" if f == "weight" else "string"})
        graph = ElementTree.SubElement(root, f"{GRAPHML}graph", {"edgedefault": "undirected"})
        for r in rows:
            ends = {"id": r["id"]} if table == "nodes" else {"source": r["src"], "target": r["dst"]}
            element = ElementTree.SubElement(graph, f"{GRAPHML}{table[:-1]}", ends)
            for k, f in enumerate(fields):
                if r[f] is not None:
                    ElementTree.SubElement(element, f"{GRAPHML}data", {"key": f"d{k}"}).text = str(r[f])
        ElementTree.register_namespace("", GRAPHML[1:-1])
        return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    if table == "vectors":
        held = {"embedding_dim": len(rows[0]["vector"] or []), "data": [{"__id__": r["id"], "entity_name": r["entity_name"], "__vector__": list(r["vector"])} for r in rows]}
    elif table == "chunks":
        held = {r["chunk_id"]: {k: v for k, v in r.asDict().items() if k not in ("video_name", "chunk_id")} for r in rows}
    else:
        held = {video: {r["segment_idx"]: {k: r[k] for k in ("time", "content", "transcript")} for r in rows}}
    return json.dumps(held, ensure_ascii=False).encode("utf-8", "surrogatepass")


class ArtefactWriter(DataSourceWriter):
    def __init__(self, root: str, table: str):
        self.root, self.table, self.job = root, table, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = _fs(self.root)
        by_video: dict[str, list[Row]] = {}
        for row in iterator:
            if row["video_name"] is None or "/" in row["video_name"] or row["video_name"].startswith((".", "_")):
                raise ValueError(f"{row['video_name']!r} can't be a folder")
            by_video.setdefault(row["video_name"], []).append(row)
        out = []
        for video, rows in by_video.items():
            system.create_dir(f"{root}/{video}", recursive=True)
            file = f"{video}/{self.job}-{uuid.uuid4().hex}-{TABLES[self.table][1]}"
            with system.open_output_stream(f"{root}/{file}") as f:
                f.write(_rendered(self.table, video, rows))
            out.append([self.table, video, file])
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _fs(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        system.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        draft = f"{root}/{MANIFESTS}/{self.job}.draft"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(files).encode())
        system.move(draft, f"{root}/{MANIFESTS}/{self.job}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes this write's files, also those of tasks that failed after they wrote some."""
        from pyarrow import fs

        system, root = _fs(self.root)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and info.base_name.startswith(self.job):
                system.delete_file(info.path)


class ArtefactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorewright"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "segments")][0]

    def reader(self, schema: StructType) -> ArtefactReader:
        return ArtefactReader(self.options["path"], self.options.get("table", "segments"))

    def writer(self, schema: StructType, overwrite: bool) -> ArtefactWriter:
        if overwrite:
            raise ValueError("artefacts are appended to; write to a new root instead")
        return ArtefactWriter(self.options["path"], self.options.get("table", "segments"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it take filters."""
    spark.dataSource.register(ArtefactSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
