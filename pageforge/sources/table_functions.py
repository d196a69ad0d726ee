"""Table functions for SQL: zip_entries(content) and word_rows(page), after register(spark)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="name string, bytes long, content binary, error string")
class ZipEntries:
    """The files in an archive, in its order; an entry or archive that can't be read is a row with its error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            yield None, None, None, f"BadZipFile: {e}"
            return
        with archive:
            for entry in archive.infolist():
                if entry.is_dir():
                    continue
                try:
                    yield entry.filename, entry.file_size, archive.read(entry), None
                except Exception as e:  # noqa: BLE001  the other entries stay
                    yield entry.filename, entry.file_size, None, f"{type(e).__name__}: {e}"


#: A recogniser's parallel columns as rows: the same as extract.columnar, said once for SQL.
WORD_ROWS = """
CREATE OR REPLACE TEMPORARY FUNCTION word_rows(texts ARRAY<STRING>, confs ARRAY<STRING>, xs ARRAY<INT>, ys ARRAY<INT>)
RETURNS TABLE (place INT, text STRING, conf DOUBLE, x INT, y INT)
RETURN SELECT pos, z.t, greatest(0D, least(1D, coalesce(try_cast(z.c AS DOUBLE), -1D) / 100)), z.x, z.y
 FROM (SELECT posexplode(arrays_zip(texts, confs, xs, ys)) AS (pos, e)) LATERAL VIEW inline(array(struct(e.texts AS t, e.confs AS c, e.xs AS x, e.ys AS y))) z
 WHERE trim(coalesce(z.t, '')) <> ''
"""


def register(spark: SparkSession) -> None:
    spark.udtf.register("zip_entries", ZipEntries)
    spark.sql(WORD_ROWS)
