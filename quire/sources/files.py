"""A data source of one file a row: section texts and artefacts, written and read by manifest.

``df.write.format("row_files").mode("overwrite").save(path)`` writes column ``text`` of each row to
the file that column ``file`` names; other columns go to the manifest. Each task writes into a
folder of its own and lists its files there; the job's commit names the tasks that count in one
small file, which is moved into place at the end. So a failed or repeated task leaves nothing to be
seen, and a failed job leaves what was there before. ``spark.read.format("row_files").load(path)``
gives the rows back, a partition for each task's list, in pieces of at most PIECE files.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.functions import text as tx

FORMAT = "row_files"
#: Files that one reading task opens at most.
PIECE = 4096
_COMMITTED = "_committed.json"


def _open(path: str):
    """The file system and the path in it of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(system, path: str, content: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(content)


def _get(system, path: str) -> bytes:
    with system.open_input_stream(path) as found:
        return found.read()


def _plain(name: str) -> str:
    """The name, if it stays below its folder."""
    clean = posixpath.normpath(name)
    if not name or clean.startswith(("/", "..")) or clean in (".", _COMMITTED):
        raise ValueError(f"not a file below its folder: {name!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: int


@dataclass
class Piece(InputPartition):
    job: str
    task: str
    first: int


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        """The schema that the last commit wrote."""
        system, base = _open(self.options["path"])
        return StructType.fromJson(json.loads(_get(system, posixpath.join(base, _COMMITTED)))["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"], schema, overwrite)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        if missing := {"file", "text"} - set(schema.names):
            raise ValueError(f"no columns {sorted(missing)}")
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = _open(self.path)
        task = f"task-{uuid.uuid4().hex}"
        folder = posixpath.join(base, self.job, task)
        system.create_dir(folder, recursive=True)
        made, files = {folder}, 0
        with system.open_output_stream(posixpath.join(folder, "_files.jsonl")) as listing:
            for row in iterator:
                said = row.asDict()
                content = (said.pop("text") or "").encode()
                target = posixpath.join(folder, _plain(said["file"]))
                if (parent := posixpath.dirname(target)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                _put(system, target, content)
                listing.write(json.dumps(said | {"__sha256": hashlib.sha256(content).hexdigest(), "__null": row["text"] is None}).encode() + b"\n")
                files += 1
        return Written(task, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        jobs = [{"job": self.job, "task": m.task, "files": m.files} for m in messages if m is not None and m.files]
        old: list[dict] = []
        try:
            old = json.loads(_get(system, posixpath.join(base, _COMMITTED)))["tasks"]
        except FileNotFoundError:
            system.create_dir(base, recursive=True)
        tasks = jobs if self.overwrite else old + jobs
        ready = posixpath.join(base, f"_{self.job}.json")
        _put(system, ready, json.dumps({"schema": self.schema.jsonValue(), "tasks": tasks}).encode())
        system.move(ready, posixpath.join(base, _COMMITTED))
        for job in {t["job"] for t in old} - {t["job"] for t in tasks}:
            system.delete_dir(posixpath.join(base, job))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _open(self.path)
        folder = posixpath.join(base, self.job)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class FilesReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Piece]:
        system, base = _open(self.path)
        tasks = json.loads(_get(system, posixpath.join(base, _COMMITTED)))["tasks"]
        return [Piece(t["job"], t["task"], first) for t in tasks for first in range(0, t["files"], PIECE)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, base = _open(self.path)
        folder = posixpath.join(base, piece.job, piece.task)
        with system.open_input_stream(posixpath.join(folder, "_files.jsonl")) as listing:
            lines = listing.read().splitlines()[piece.first : piece.first + PIECE]
        for line in lines:
            said = json.loads(line)
            content = _get(system, posixpath.join(folder, _plain(said["file"])))
            if hashlib.sha256(content).hexdigest() != said["__sha256"]:
                raise ValueError(f"{said['file']} is not what was written")
            said["text"] = None if said["__null"] else content.decode()
            yield tuple(said.get(name) for name in self.schema.names)


def section_files(sections: DataFrame) -> DataFrame:
    """``sections`` (book, number, title, text) with ``file``: a folder a book, ``NNN-title.txt`` in it."""
    title = F.coalesce(F.nullif(tx.slug(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("section"))
    number = F.col("number").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    return sections.withColumn("file", F.concat(tx.folder_slug(F.coalesce("book", F.lit(""))), F.lit("/"), padded, F.lit("-"), F.substring(title, 1, 64), F.lit(".txt")))


def artefact(rows: DataFrame, file: str, *columns: str) -> DataFrame:
    """Rows (file, text) of one JSON artefact a row, readable and with null fields, named after ``file``'s column."""
    return rows.select(F.concat(F.col(file), F.lit(".json")).alias("file"), F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.sparkSession.dataSource.register(RowFiles)
    rows.write.format(FORMAT).mode(mode).save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RowFiles)
    return spark.read.format(FORMAT).load(path)
