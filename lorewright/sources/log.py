"""A table with an atomic commit log: readers see whole batches, each once, whatever failed between (S4).

A batch's rows and the keys that it has dealt with are written to a folder of their own that nothing reads yet. The commit is
one file, batch-<number>, that names the folder: it is written under another name and renamed to one that must not exist, so
of two attempts at a batch one wins. A batch that the log already has is skipped. Readers take only folders that the log
names; those of failed attempts are left for vacuum(). All files are reached through Hadoop's FileSystem, as Spark's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class LoggedTable:
    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, at, at("_log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> dict[int, str]:
        """Folders of the batches that were committed."""
        jvm, at, fs = self._fs()
        if not fs.exists(at("_log")):
            return {}
        out = {}
        for status in fs.listStatus(at("_log")):
            name = status.getPath().getName()
            if name.startswith("batch-"):
                stream = fs.open(status.getPath())
                try:
                    out[int(name.removeprefix("batch-"))] = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folder"]
                finally:
                    stream.close()
        return out

    def _read(self, part: str) -> DataFrame | None:
        folders = [f"{self.path}/{f}/{part}" for f in self.log().values()]
        return self.spark.read.parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        """All committed rows; None before the first commit."""
        return self._read("rows")

    def keys(self) -> DataFrame | None:
        return self._read("keys")

    def append(self, rows: DataFrame, number: int, key: str | None = None) -> bool:
        """Writes rows and their keys and commits both as batch `number`; False if the log has that batch."""
        if number in self.log():
            return False
        folder = f"data-{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}/rows")
        # The keys are those of the rows as they were written.
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}/rows")
        (written.select(key).distinct() if key else written.select().limit(0).withColumn("none", F.lit(0))).write.parquet(f"{self.path}/{folder}/keys")
        return self._commit(number, folder)

    def _commit(self, number: int, folder: str) -> bool:
        jvm, at, fs = self._fs()
        fs.mkdirs(at("_log"))
        draft = at(f"_log/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(json.dumps({"folder": folder}).encode())
        finally:
            stream.close()
        # FileContext's rename without the overwrite option fails where the target exists.
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(at(f"_log/batch-{number}")), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if number in self.log():
                return False
            raise RuntimeError(f"batch {number} was not committed") from e
        return True

    def vacuum(self) -> int:
        """Removes folders that no commit names, where no writer is at work; how many there were."""
        _, at, fs = self._fs()
        named, gone = set(self.log().values()), 0
        for status in fs.listStatus(at("")) if fs.exists(at("_log")) else []:
            if status.getPath().getName().startswith("data-") and status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone


def ingest_once(stream: DataFrame, target: LoggedTable, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends each batch's rows whose key was in no earlier batch, rows and keys in one commit.

    A batch that is replayed after any failure is either committed already, and skipped, or was never seen by readers.
    """

    def each(batch: DataFrame, number: int) -> None:
        known = target.keys()
        new = batch if known is None else batch.join(known.select(key), key, "left_anti")
        target.append(transform(new), number, key)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
