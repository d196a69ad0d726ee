"""Plug-ins for formats that need a library, where it is installed, and the reader of spelling dictionaries.

Nothing here is imported before it is used, on the executor that uses it; without the library, the files that need it
give an error row that names it.
"""

from __future__ import annotations

import importlib
import importlib.util
import io
import pathlib
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.sources.documents import Readers

#: Seconds that a conversion may take.
CONVERT = 120


def _library(name: str, what: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"{what} needs the library {name}, which is not installed here") from e


def pdf_text(content: bytes, max_pages: int) -> list[str]:
    with _library("pdfplumber", "reading PDF text").open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages[:max_pages]]


def pdf_images(content: bytes, max_pages: int, dpi: int) -> list[bytes]:
    fitz = _library("fitz", "turning PDF pages into images")
    with fitz.open(stream=content, filetype="pdf") as pdf:
        scale = fitz.Matrix(dpi / 72, dpi / 72)
        return [pdf[k].get_pixmap(matrix=scale, alpha=False).tobytes("png") for k in range(min(len(pdf), max_pages))]


def frames(content: bytes, max_pages: int) -> list[bytes]:
    """The frames of an image, each as a PNG in three channels."""
    images, found = _library("PIL.Image", "reading image frames"), []
    with images.open(io.BytesIO(content)) as image:
        for k in range(min(getattr(image, "n_frames", 1), max_pages)):
            image.seek(k)
            out = io.BytesIO()
            image.convert("RGB").save(out, "PNG")
            found.append(out.getvalue())
    return found


def decodes(content: bytes) -> bool:
    images = _library("PIL.Image", "checking pictures")
    try:
        with images.open(io.BytesIO(content)) as image:
            image.convert("RGB")
        return True
    except Exception:  # noqa: BLE001  whatever is wrong with it, it can't be read
        return False


def convert(content: bytes, suffix: str) -> bytes:
    """The PDF of an old office file, by an office program on the executor's path."""
    program = shutil.which("soffice") or shutil.which("libreoffice")
    if not program:
        raise RuntimeError("converting old office files needs soffice, which is not installed here")
    with tempfile.TemporaryDirectory() as d:  # the program takes files only; nothing else reads them
        source = pathlib.Path(d, f"file{suffix}")
        source.write_bytes(content)
        subprocess.run([program, "--headless", "--convert-to", "pdf", "--outdir", d, str(source)], check=True, capture_output=True, timeout=CONVERT)
        return source.with_suffix(".pdf").read_bytes()


def standard() -> Readers:
    """All of these; pictures are checked only where the library for it is there."""
    known = importlib.util.find_spec("PIL") is not None
    return Readers(pdf_text=pdf_text, pdf_images=pdf_images, convert=convert, frames=frames if known else None, decodes=decodes if known else None)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) from text files with a term and its count on each line; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    found = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return found.select(F.col("p")[0].alias("term"), F.expr("try_cast(p[1] AS bigint)").alias("freq")).where("term <> '' AND freq IS NOT NULL")
