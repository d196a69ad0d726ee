"""Documents from any store that Spark reads: files by allowed suffix, paragraphs and pictures of zipped office files.

The content column is read only for files that pass the suffix filter, and page limits apply inside the reader.
Recognition of pixels is a plug-in: a WordExtractor gets an image and gives word rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.operators.extract import ALLOWED, dispatch

MAX_FILES = 10
PAGES = "doc string, page_index int, native_text string, image binary, error string"


class WordExtractor(Protocol):
    def __call__(self, image: bytes) -> list[tuple[str, float, int, int, int, int]]:
        """(text, confidence 0..1, x1, y1, x2, y2) of each word."""


@dataclass(frozen=True)
class Readers:
    """Plug-ins for formats that need a library of their own; without one, a file of that format gives an error row.

    pdf_text(content, max_pages): each page's native text. pdf_images(content, max_pages, dpi): each page as an image.
    convert(content, suffix): the PDF of an old office file. frames(content, max_pages): the frames of a TIFF (without
    it, the file is one image). decodes(content): whether a picture of an office file can be read; those that can't are
    left out before pages are counted (without it, all are taken). `sources.readers.standard` has these where their
    libraries are installed.
    """

    pdf_text: Callable[[bytes, int], list[str]] | None = None
    pdf_images: Callable[[bytes, int, int], list[bytes]] | None = None
    convert: Callable[[bytes, str], bytes] | None = None
    frames: Callable[[bytes, int], list[bytes]] | None = None
    decodes: Callable[[bytes], bool] | None = None


def options(dpi: int = 150, max_pages: int = 5, preset: str = "auto") -> dict:
    """Checked options: dpi 72 to 600, pages 1 to 200, a known preset (another one means auto)."""
    if not 72 <= dpi <= 600 or not 1 <= max_pages <= 200:
        raise ValueError("dpi must be 72 to 600 and max_pages 1 to 200")
    p = preset.strip().lower()
    return {"dpi": dpi, "max_pages": max_pages, "preset": p if p in ("auto", "clean_doc", "photo", "low_light") else "auto"}


def files(spark: SparkSession, path: str | list[str], key: str = "filename") -> DataFrame:
    """doc (the filename, or with key="path" the whole path), suffix, input_type, content of the files with allowed
    suffixes, in either case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = dispatch(found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content"))
    return named.where("allowed").select(F.col(key).alias("doc"), "suffix", "input_type", "content")


def batch(spark: SparkSession, path: str) -> DataFrame:
    """files(), after checking that there are 1 to MAX_FILES of them and that all have an allowed suffix."""
    names = dispatch(spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename")))
    total, bad = names.count(), names.where("NOT allowed").count()
    if not 1 <= total <= MAX_FILES or bad:
        allowed = ", ".join(sorted(f".{x}" for x in ALLOWED))
        raise ValueError(f"1 to {MAX_FILES} files of allowed types are wanted; {total} found, {bad} of them not allowed; allowed: {allowed}")
    return files(spark, path)


def _texts(xml: bytes, paragraph: str) -> list[str]:
    root = ElementTree.fromstring(xml)
    joined = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith(paragraph))
    return [t.strip() for t in joined if t.strip()]


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id: (kind, path inside the archive) of what a part refers to."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    found = ElementTree.fromstring(z.read(rels))
    return {r.get("Id", ""): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found if r.get("TargetMode") != "External"}


def _slides(z: zipfile.ZipFile) -> list[str]:
    """Slide parts in the order of the presentation; by number where it names none."""
    main, names = "ppt/presentation.xml", set(z.namelist())
    if main in names:
        parts = {k: path for k, (kind, path) in _targets(z, main).items() if kind == "slide"}
        ids = [v for e in ElementTree.fromstring(z.read(main)).iter() if e.tag.endswith("}sldId") for k, v in e.attrib.items() if k.endswith("}id")]
        if found := [parts[i] for i in ids if parts.get(i) in names]:
            return found
    numbered = [m for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in names) if m]
    return [m[0] for m in sorted(numbered, key=lambda m: int(m[1]))]


def _shapes(xml: bytes) -> list[str]:
    """The texts of a slide's shapes that have one, paragraphs as lines; of its paragraphs where it has no shapes."""
    shapes = [e for e in ElementTree.fromstring(xml).iter() if e.tag.endswith("}sp")]
    texts = []
    for shape in shapes:
        paragraphs = (p for p in shape.iter() if p.tag.endswith("}p"))
        texts.append("\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in paragraphs).strip())
    return [t for t in texts if t] if shapes else _texts(xml, "}p")


def _media(z: zipfile.ZipFile, name: str, readers: Readers) -> bytes | None:
    """A picture's content; None for one that can't be read or decoded."""
    if name.lower().endswith((".wmf", ".emf")):
        return None
    try:
        data = z.read(name)
        return data if readers.decodes is None or readers.decodes(data) else None
    except Exception:  # noqa: BLE001  one bad part is left out, the file's others stay
        return None


def _picture(z: zipfile.ZipFile, slide: str, readers: Readers) -> bytes | None:
    """The first picture of a slide that can be read, in the order of its shapes."""
    parts, names = _targets(z, slide), set(z.namelist())
    for e in ElementTree.fromstring(z.read(slide)).iter():
        if e.tag.endswith("}blip"):
            for k, v in e.attrib.items():
                if k.endswith("}embed") and parts.get(v, ("", ""))[1] in names and (data := _media(z, parts[v][1], readers)):
                    return data
    return None


def office_page(suffix: str, archive: zipfile.ZipFile, page: int, readers: Readers = Readers()) -> tuple[str | None, bytes | None] | None:
    """(native_text, image) of one page, None where there is no such page: a word file's text, then its pictures that can
    be read; a slide's text and first picture."""
    if suffix == ".docx":
        if page == 0:
            try:
                return "\n".join(_texts(archive.read("word/document.xml"), "}p")), None
            except (KeyError, ElementTree.ParseError):
                return "", None
        media = (_media(archive, n, readers) for n in archive.namelist() if n.startswith("word/media/"))
        found = next(islice((data for data in media if data), page - 1, None), None)
        return found and (None, found)
    slides = _slides(archive)
    if page >= len(slides):
        return None
    return "\n".join(_shapes(archive.read(slides[page]))), _picture(archive, slides[page], readers)


def office_pages(suffix: str, content: bytes, max_pages: int, readers: Readers = Readers()) -> list[tuple]:
    """Rows (page_index, native_text, image): a text page and up to max_pages pictures, or one row per slide, with its
    text and its first picture. Parts that can't be read are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if suffix == ".docx":
            media = (_media(z, n, readers) for n in names if n.startswith("word/media/"))
            pictures = list(islice((data for data in media if data), max_pages))
            try:
                text = "\n".join(_texts(z.read("word/document.xml"), "}p"))
            except (KeyError, ElementTree.ParseError):
                text = ""
            return [(0, text, None), *((k + 1, None, data) for k, data in enumerate(pictures))]
        return [(k, "\n".join(_shapes(z.read(n))), _picture(z, n, readers)) for k, n in enumerate(_slides(z)[:max_pages])]


#: Characters from which on a page has native text.
NATIVE = 200


def pdf_pages(content: bytes, max_pages: int, dpi: int, readers: Readers) -> list[tuple]:
    """Native texts of all pages if one has enough of it, else images; images are made only then."""
    texts = [t.strip() for t in readers.pdf_text(content, max_pages)][:max_pages] if readers.pdf_text else []
    if any(len(t) >= NATIVE for t in texts):
        return [(k, t, None) for k, t in enumerate(texts)]
    if not readers.pdf_images:
        raise ValueError("no plug-in makes images of PDF pages")
    return [(k, None, i) for k, i in enumerate(readers.pdf_images(content, max_pages, dpi)[:max_pages])]


def file_pages(suffix: str, content: bytes, max_pages: int, dpi: int, readers: Readers) -> list[tuple]:
    """Rows (page_index, native_text, image) of one file."""
    if suffix in (".doc", ".ppt"):
        if not readers.convert:
            raise ValueError("no plug-in converts old office files")
        suffix, content = ".pdf", readers.convert(content, suffix)
    if suffix == ".pdf":
        return pdf_pages(content, max_pages, dpi, readers)
    if suffix in (".docx", ".pptx"):
        return office_pages(suffix, content, max_pages, readers)
    images = readers.frames(content, max_pages)[:max_pages] if readers.frames and suffix in (".tif", ".tiff") else [content]
    return [(k, None, i) for k, i in enumerate(images)]


def page_sources(found: DataFrame, max_pages: int = 5, dpi: int = 150, readers: Readers = Readers()) -> DataFrame:
    """doc, page_index, native_text, image, error: one row per page; a file that can't be read gives a row with its error."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())

    def run(batches):
        for b in batches:
            for doc, suffix, content in zip(*(b.column(i) for i in range(3))):
                name = doc.as_py()
                try:
                    rows = [(name, k, t, i, None) for k, t, i in file_pages(suffix.as_py(), content.as_py(), max_pages, dpi, readers)]
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                    rows = [(name, 0, None, None, f"{type(e).__name__}: {e}")]
                if rows:  # a file at a time: its pages' images are what memory holds
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc", "page_index", "native_text", "image", "error"])

    return found.select("doc", "suffix", "content").mapInArrow(run, PAGES)


def extract_words(pages: DataFrame, extractor: WordExtractor) -> DataFrame:
    """doc, page_index, seq, text, conf, x1, y1, x2, y2 of pages with an image; blank words go."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, page, image in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows += [(doc, page, k, *w) for k, w in enumerate(w for w in extractor(image) if w[0].strip())]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc", "page_index", "seq", "text", "conf", "x1", "y1", "x2", "y2"])

    return pages.where("image IS NOT NULL").select("doc", "page_index", "image").mapInArrow(run, "doc string, page_index int, seq int, text string, conf double, x1 int, y1 int, x2 int, y2 int")
