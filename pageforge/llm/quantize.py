"""Compression of vectors to codes by product quantization, with a filtering form of Lloyd's algorithm.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own. A task takes its
vectors block by block and builds, per part position, a kd-tree over the block's parts: cells are ranges of one order,
halved at the median of their widest component, with box, sums and count cached per cell. Assignment goes down the tree
a level at a time with the entries that can still be nearest somewhere in a cell's box: the entry nearest to the box's
middle stays, and any other that is farther than it at the box's corner that favours it most goes. A cell with one entry
left is assigned whole, by its cached sums and count; what reaches a leaf is compared part by part. All of this is in
integers, so results are those of comparing every part with every entry, ties to the lower index included.

A round is one pass: codebooks (parts * entries rows, whatever the input) go to all tasks with the plan, and each task
gives one row of count and sums per part position and entry, which are added up by a shuffle before they go back.

Defined results: vectors that are null or empty, or hold a null or non-finite component, take no part, nor do vectors
whose length isn't that of the kept vector with the smallest id, which must be a multiple of the number of parts; a
vector without an id gets a code but starts no entry; where an id repeats, its least vector starts one entry; fewer ids
than entries give fewer entries; entries that no part takes stay; equal entries and equally near ones: the lower index;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.storage import stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block, parts of a leaf, cells that are looked at together.
BLOCK, LEAF, TOGETHER = 8192, 16, 1024


class Tree:
    """A kd-tree over parts (rows of integers): `order` sorts them by cell; a level is (first, end, low, high, sums)."""

    def __init__(self, parts: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(parts))
        bounds, self.levels = np.array([0, len(parts)]), []
        while True:
            placed = parts[self.order]
            first, end = bounds[:-1], bounds[1:]
            low, high = np.minimum.reduceat(placed, first), np.maximum.reduceat(placed, first)
            self.levels.append((first, end, low, high, np.add.reduceat(placed, first)))
            # every cell is halved until the largest is a leaf, so the children of cell k are 2k and 2k + 1
            if (end - first).min() < 2 or (end - first).max() <= leaf:
                break
            cell = np.repeat(np.arange(len(first)), end - first)
            widest = (high - low).argmax(axis=1)
            self.order = self.order[np.lexsort((placed[np.arange(len(placed)), widest[cell]], cell))]
            bounds = np.unique(np.r_[bounds, (first + end) // 2])
        self.parts = parts[self.order]

    def assign(self, book: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """(counts, sums) of the parts that each entry of `book` is nearest to, and the share of parts that were
        assigned with a whole cell; codes, if given, takes each part's entry."""
        size, width = book.shape
        counts, sums, whole = np.zeros(size, np.int64), np.zeros((size, width), np.int64), 0
        cells, may = np.zeros(1, np.int64), np.ones((1, size), bool)
        for depth, (first, end, low, high, total) in enumerate(self.levels):
            last, next_cells, next_may = depth + 1 == len(self.levels), [], []
            for a in range(0, len(cells), TOGETHER):
                at, left = cells[a : a + TOGETHER], self._filter(low[cells[a : a + TOGETHER]], high[cells[a : a + TOGETHER]], book, may[a : a + TOGETHER])
                done = left.sum(axis=1) == 1
                one, entry = at[done], left[done].argmax(axis=1)
                np.add.at(counts, entry, end[one] - first[one])
                np.add.at(sums, entry, total[one])
                whole += int((end[one] - first[one]).sum())
                if codes is not None and len(one):
                    codes[self.order[_ranges(first[one], end[one])]] = np.repeat(entry, end[one] - first[one])
                at, left = at[~done], left[~done]
                if not last:
                    next_cells.append(np.stack([2 * at, 2 * at + 1], axis=1).ravel())
                    next_may.append(np.repeat(left, 2, axis=0))
                elif len(at):
                    rows = _ranges(first[at], end[at])
                    x = self.parts[rows]
                    apart = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
                    entry = np.where(np.repeat(left, end[at] - first[at], axis=0), apart, np.iinfo(np.int64).max).argmin(axis=1)
                    np.add.at(counts, entry, 1)
                    np.add.at(sums, entry, x)
                    if codes is not None:
                        codes[self.order[rows]] = entry
            if last or not sum(map(len, next_cells)):
                break
            cells, may = np.concatenate(next_cells), np.concatenate(next_may)
        return counts, sums, whole / max(1, len(self.parts))

    @staticmethod
    def _filter(low: np.ndarray, high: np.ndarray, book: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Which of the entries that `may` be nearest in the boxes still may."""
        middle = low + high  # twice the middle, against twice the entries
        apart = ((middle[:, None, :] - 2 * book[None]) ** 2).sum(axis=2)
        best = np.where(may, apart, np.iinfo(np.int64).max).argmin(axis=1)
        chosen = book[best][:, None, :]
        corner = np.where(book[None] > chosen, high[:, None, :], low[:, None, :])
        lead = ((corner - book[None]) ** 2).sum(axis=2) - ((corner - chosen) ** 2).sum(axis=2)
        # an entry that does as well in that corner may win a tie there, if its index is lower
        stays = (lead < 0) | ((lead == 0) & (np.arange(len(book))[None] <= best[:, None]))
        stays[np.arange(len(best)), best] = True
        return may & stays


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first .. end - 1, one after the other."""
    sizes = end - first
    return np.arange(sizes.sum()) + np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def _matrices(batches, column: int, width: int, block: int):
    """(rows, matrix): the batches' other columns and vectors, at most `block` vectors at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, block):
            part = batch.slice(k, block)
            vectors = part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
            yield part, vectors


def _sums(books: np.ndarray, block: int):
    """(part, entry, count, sums) of each task's vectors."""
    many, size, width = books.shape

    def run(batches):
        counts, sums = np.zeros((many, size), np.int64), np.zeros((many, size, width), np.int64)
        for _, x in _matrices(batches, 0, many * width, block):
            for p in range(many):
                c, s, _ = Tree(x[:, p * width : (p + 1) * width]).assign(books[p])
                counts[p] += c
                sums[p] += s
        p, e = np.nonzero(counts)
        values = pa.array(list(sums[p, e]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), values], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, block: int):
    """The batches' rows with code (bytes) and error in place of the vector, their last column."""
    many, size, width = books.shape

    def run(batches):
        for part, x in _matrices(batches, 2, many * width, block):
            codes, error = np.zeros((len(x), many), np.int64), np.zeros(len(x), np.int64)
            for p in range(many):
                own = x[:, p * width : (p + 1) * width]
                Tree(own).assign(books[p], codes[:, p])
                error += ((own - books[p][codes[:, p]]) ** 2).sum(axis=1)
            digits = 2 if size <= 256 else 4
            text = [b.tobytes().hex() for b in codes.astype(f">u{digits // 2}")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * component), component as double, of whole vectors."""
    whole = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall(
        "embedding", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    )
    return table.where(F.col("embedding").isNotNull() & whole).select(
        "vec_id", "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> np.ndarray:
    """Codebooks (parts, entries, width) of vectors (vec_id, label, v), after `rounds` of assignment and replacement."""
    known = vectors.where("vec_id IS NOT NULL")
    head = known.orderBy("vec_id").select(F.size("v")).first()
    width = head[0] if head else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    alike = known.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    starts = [r[0] for r in alike.orderBy("vec_id").limit(entries).select("v").collect()]  # `entries` rows
    books = np.array(starts, np.int64).reshape(len(starts), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(starts) else 0):
        rows = vectors.where(F.size("v") == width).select("v").mapInArrow(_sums(books, block), "part int, entry int, n long, sums array<long>")
        summed = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width // parts)])
        for p, e, n, *sums in summed.collect():  # at most parts * entries rows
            books[p, e] = [s // n for s in sums]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, block: int = BLOCK) -> DataFrame:
    """vec_id, label, code (hexadecimal entry of each part), error (squared distance to the coded vector)."""
    width, kind = books.shape[0] * books.shape[2], vectors.schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long"
    return vectors.where(F.size("v") == width).select("vec_id", "label", "v").mapInArrow(_codes(books, block), schema)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label and v, the vector that a code stands for."""
    many, size, width = books.shape
    digits = 2 if size <= 256 else 4
    table = F.array(*[F.array(*[F.lit(int(c)) for c in entry]) for part in books for entry in part])
    spot = lambda p: F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int") + p * size + 1
    return codes.select("vec_id", "label", F.flatten(F.array(*[F.element_at(table, spot(p)) for p in range(many)])).alias("v"))


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, code, error, label_error (error summed over a label's vectors), codebooks_sha256."""
    vectors = stored(integer_vectors(table), "quantize-vectors")
    books = train(vectors, parts, entries, rounds, block)
    coded = stored(encode(vectors, books, block), "quantize-codes")
    by_label = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "quantize-labels")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
