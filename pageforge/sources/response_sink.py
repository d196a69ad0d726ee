"""Responses as files: df.write.format("responses").mode("append").save(folder), all of a job or nothing.

Every task writes one file of JSON lines into the job's own folder under the target. When all are done they are moved to
their place; a failed job's folder goes, with whatever its tasks have left there. mode("overwrite") first writes, then
removes what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ResponseWriter(self.options["path"], overwrite)


class ResponseWriter(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.job = target, overwrite, uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        system, path = _located(self.target)
        return system, path.rstrip("/"), f"{path.rstrip('/')}/.job-{self.job}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, _, own = self._places()
        system.create_dir(own)
        path, many = f"{own}/part-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(path) as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                many += 1
        return Written(path, many)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target, own = self._places()
        system.create_dir(target)
        before = [f.path for f in system.get_file_info(fs.FileSelector(target)) if f.type == fs.FileType.File]
        for done in messages:
            if done is not None and done.rows:
                system.move(done.path, f"{target}/{done.path.rpartition('/')[2]}")
        if self.overwrite:
            for path in before:
                system.delete_file(path)
        self._clean(system, own)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, own = self._places()
        self._clean(system, own)

    @staticmethod
    def _clean(system: fs.FileSystem, own: str) -> None:
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)
