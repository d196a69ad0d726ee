"""Office files as a data source: spark.read.format("office_pages").load(folder), one task for a page of some files.

Planning lists names only. A task opens its files where they are, by pyarrow's file systems, and reads an archive's
directory and the parts of one page, so pages of one file are read beside each other and no archive is in memory whole.
`max_pages` bounds the tasks that are planned. register(spark) makes the source and the sink of office_sink known.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pageforge.sources.documents import Readers, office_page

SUFFIXES = (".docx", ".pptx")
#: Pages of a file that are read, files of a task, bytes up to which a file is read at once.
MAX_PAGES, FILES, SMALL = 5, 16, 1 << 16


@dataclass
class Pages(InputPartition):
    """One page of some files."""

    paths: tuple[str, ...]
    page: int


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class OfficePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office_pages"

    def schema(self) -> str:
        return "doc string, page_index int, native_text string, image binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return OfficeReader(self.options)


class OfficeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.max_pages, self.files = int(options.get("max_pages", MAX_PAGES)), int(options.get("files", FILES))
        if not 1 <= self.max_pages <= 200:
            raise ValueError("max_pages must be 1 to 200")

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES))
        groups = [tuple(names[k : k + self.files]) for k in range(0, len(names), self.files)]
        # a word file's text is a page before its pictures
        return [Pages(group, page) for group in groups for page in range(self.max_pages + 1)] or [Pages((), 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        system, _ = located(self.path)
        for path in partition.paths:
            name, suffix = posixpath.basename(path), posixpath.splitext(path)[1].lower()
            if suffix == ".pptx" and partition.page == self.max_pages:
                continue
            try:
                with system.open_input_file(path) as file:
                    # small files are one request; of others only the directory and the page's parts are read
                    with zipfile.ZipFile(io.BytesIO(file.read()) if file.size() <= SMALL else file) as archive:
                        found = office_page(suffix, archive, partition.page, Readers())
                if found:
                    yield (name, partition.page, *found, None)
            except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                if partition.page == 0:
                    yield name, 0, None, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> None:
    from pageforge.sources.response_sink import Responses

    spark.dataSource.register(OfficePages)
    spark.dataSource.register(Responses)
