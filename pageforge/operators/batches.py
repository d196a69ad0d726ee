"""Steps on pages, many pages at once, in numpy on Arrow batches: a row is a page, its words are an array.

Spark cuts, shuffles and gathers the pages; what happens inside of a page is worked out here for some thousand pages together.
Numbers are doubles and null is NaN: comparisons with it are false and sums over it are null, as in SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pages that are worked on at once; words from which a page is folded by itself.
ROWS, LARGE = 2000, 1000
#: White space that is stripped, as in functions.text.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def apply(step):
    """step, on record batches of at most ROWS pages, for mapInArrow."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield step(batch.slice(k, ROWS))

    return run


def doubles(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def ints(values: np.ndarray, kind=pa.int32()) -> pa.Array:
    """Whole numbers; NaN becomes null."""
    null = np.isnan(values)
    return pa.array(np.where(null, 0, values).astype(np.int64), pa.int64(), mask=null).cast(kind)


def first(values: np.ndarray) -> np.ndarray:
    """A sort key: null comes first."""
    return np.where(np.isnan(values), -np.inf, values)


def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def at_starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def ranks(texts: pa.Array) -> np.ndarray:
    """Numbers in the order of the texts' bytes, null first."""
    return pc.rank(texts, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def sorted_by(texts: pa.Array, *keys: np.ndarray) -> np.ndarray:
    """An order by the keys, the first one first, and then by the texts, which are looked at only where keys tie."""
    order = np.lexsort(keys[::-1])
    tie = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        tie &= key[order[1:]] == key[order[:-1]]
    return np.lexsort((ranks(texts), *keys[::-1])) if tie.any() else order


def joined(texts: pa.Array, sizes: np.ndarray, separator: str) -> pa.Array:
    """Runs of texts as one text each; null is left out."""
    if texts.null_count:
        there = np.asarray(texts.is_valid())
        sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])])
        texts = texts.drop_null()
    return pc.binary_join(lists(sizes, texts), separator)


def fold(sizes: np.ndarray, y: np.ndarray, limit: np.ndarray, mean: bool, strict: bool) -> np.ndarray:
    """Numbers of runs, from 0 on each page: an item goes on with a run while it is within the page's limit (strict: below it)
    of the run's running mean, or of its first item. All pages take a step together; a large one goes by itself."""
    out, starts = np.zeros(len(y), np.int64), at_starts(sizes)
    order = np.argsort(-sizes, kind="stable")
    large = int((sizes > LARGE).sum())
    for p in order[:large]:
        m, k, n, thr, found = 0.0, 0, -1, limit[p], []
        for v in y[starts[p] : starts[p] + sizes[p]].tolist():
            if k and (abs(v - m) < thr if strict else abs(v - m) <= thr):
                if mean:
                    m = (m * k + v) / (k + 1)
                k += 1
            else:
                m, k, n = v, 1, n + 1
            found.append(n)
        out[starts[p] : starts[p] + sizes[p]] = found
    order = order[large:]
    sizes, starts, thr = sizes[order], starts[order], limit[order]
    m, k, n = np.zeros(len(order)), np.zeros(len(order)), np.full(len(order), -1)
    left = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right") if len(order) else []
    for j, many in enumerate(left):  # pages that have an item j come first
        v = y[starts[:many] + j]
        away = np.abs(v - m[:many])
        same = (k[:many] > 0) & (away < thr[:many] if strict else away <= thr[:many])
        m[:many] = np.where(same, (m[:many] * k[:many] + v) / (k[:many] + 1) if mean else m[:many], v)
        k[:many] = np.where(same, k[:many] + 1, 1)
        n[:many] += ~same
        out[starts[:many] + j] = n[:many]
    return out


class Words:
    """The words of a batch's pages (page_id and an array o, and more columns): sizes of the pages, each word's page, fields."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, column = batch, batch.column(batch.schema.get_field_index("o"))
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.own = column.flatten()
        self.page = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.own, name)

    def numbers(self, *names: str) -> list[np.ndarray]:
        return [doubles(self.field(n)) for n in names]


def placed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by page and vertical centre, and beside it the number of each word's line on its page."""
    seq, x1, y1, y2 = words.numbers("seq", "x1", "y1", "y2")
    yc, high = (y1 + y2) / 2, np.fmax(1, y2 - y1)
    order = np.lexsort((first(seq), first(x1), first(yc), words.page))
    there = np.flatnonzero(words.sizes)
    limit = np.zeros(len(words.sizes))
    middle = at_starts(words.sizes)[there] + words.sizes[there] // 2
    limit[there] = np.maximum(8, 0.65 * high[np.lexsort((high, words.page))][middle])
    return order, fold(words.sizes, yc[order], limit, True, False)


def line_rows(own: list[str]):
    """For mapInArrow: the words as rows (page_id, own, line_no)."""
    def step(batch):
        words = Words(batch)
        order, line = placed(words)
        page = words.column("page_id").take(pa.array(words.page[order]))
        taken = words.own.take(pa.array(order))
        return pa.RecordBatch.from_arrays([page, *(pc.struct_field(taken, c) for c in own), pa.array(line, pa.int32())], names=["page_id", *own, "line_no"])

    return apply(step)


LINES = "array<struct<line_no:int,conf:double,bx1:int,by1:int,bx2:int,by2:int,n_words:bigint,line_text:string>>"


def _lines(batch):
    words = Words(batch)
    order, line = placed(words)
    page = words.page[order]
    begins = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (line[1:] != line[:-1])]) if len(order) else np.zeros(0, bool))
    n = np.diff(np.append(begins, len(order)))
    seq, x1, y1, x2, y2, ca = (v[order] for v in words.numbers("seq", "x1", "y1", "x2", "y2", "ca"))
    text = words.field("text").take(pa.array(order))
    row = np.repeat(np.arange(len(begins)), n)
    along = sorted_by(text, row, first(x1), first(y1), first((y1 + y2) / 2), first(seq))
    text = pc.utf8_trim(joined(pc.utf8_trim(text.take(pa.array(along)), WHITE), n, " "), WHITE)
    conf = np.floor(np.add.reduceat(np.nan_to_num(ca), begins) * 1e4 / n + 0.5) / 1e6 if len(begins) else np.zeros(0)  # half up
    box = [ints(f.reduceat(v, begins) if len(begins) else v) for f, v in ((np.fmin, x1), (np.fmin, y1), (np.fmax, x2), (np.fmax, y2))]
    found = pa.StructArray.from_arrays(
        [pa.array(line[begins], pa.int32()), pa.array(conf), *box, pa.array(n, pa.int64()), text],
        names=["line_no", "conf", "bx1", "by1", "bx2", "by2", "n_words", "line_text"],
    )
    kept = np.asarray(pc.not_equal(text, ""))
    many = np.bincount(page[begins][kept], minlength=batch.num_rows)
    there = pa.array(np.flatnonzero(many))
    return pa.RecordBatch.from_arrays([words.column("page_id").take(there), lists(many[many > 0], found.filter(pa.array(kept)))], names=["page_id", "lines"])


page_lines = apply(_lines)


def geometry(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per page: the median of its words' heights (null without words), and the middle of its gutter or -1."""
    pages = len(words.sizes)
    x1, y1, x2, y2 = words.numbers("x1", "y1", "x2", "y2")
    w, h = doubles(words.column("w_px")), doubles(words.column("h_px"))
    high, begins, there = y2 - y1, at_starts(words.sizes), np.flatnonzero(words.sizes)
    ordered = high[np.lexsort((first(high), words.page))]
    median = np.full(pages, np.nan)
    median[there] = (ordered[begins[there] + (words.sizes[there] - 1) // 2] + ordered[begins[there] + words.sizes[there] // 2]) / 2

    lo, hi, yc = np.trunc(w * 0.10), np.trunc(w * 0.25), (y1 + y2) / 2
    wide = w > 1.1 * h
    band = wide[words.page] & (yc > 0.15 * h[words.page]) & (yc < 0.85 * h[words.page])
    has = np.bincount(words.page[band], minlength=pages) > 0
    cover = np.flatnonzero(band & (x2 > x1) & (x1 < hi[words.page]) & (x2 > lo[words.page]))
    # each page's stretches, and at its end one that begins at hi
    ends = np.flatnonzero(has)
    page = np.concatenate([words.page[cover], ends])
    a = np.concatenate([np.maximum(x1[cover], lo[words.page[cover]]), hi[ends]])
    b = np.concatenate([np.minimum(x2[cover], hi[words.page[cover]]), hi[ends]])
    last = np.concatenate([np.zeros(len(cover)), np.ones(len(ends))])
    order = np.lexsort((b, a, last, page))
    page, a, b = page[order], a[order], b[order]
    sidebar = np.full(pages, -1.0)
    if len(page):
        start = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
        # how far the cover reaches before each stretch: a running maximum, pages being kept apart by a step that is larger
        step = float(max(np.max(b), np.max(hi[ends]), 0) - min(np.min(a), np.min(lo[ends]), 0) + 1)
        far = np.maximum.accumulate(b + page * step) - page * step
        reach = np.concatenate([[0.0], far[:-1]])
        reach[start] = lo[page[start]]
        reach = np.maximum(reach, lo[page])
        gap = np.maximum(0, a - reach)
        most = np.maximum.reduceat(gap, start)
        best = np.flatnonzero(gap == np.repeat(most, np.diff(np.append(start, len(page)))))
        best = best[np.searchsorted(best, start)]  # the first of several
        p, s = page[start], np.where(most > 0, reach[best], lo[page[start]])
        sidebar[p] = np.where(most > 0.02 * w[p], np.minimum(s + most / 2, 0.22 * w[p]), -1)
    return median, sidebar


def _gutter(batch):
    words = Words(batch)
    median, sidebar = geometry(words)
    return pa.RecordBatch.from_arrays([words.column("page_id"), pa.array(median, mask=np.isnan(median)), pa.array(sidebar)], names=["page_id", "median_h", "sidebar"])


page_geometry = apply(_gutter)
ZONES = np.array(["HEADER", "SIDEBAR", "BODY", "FOOTER"])


def zoned(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """median_h and sidebar of pages, and each word's zone, as its place in ZONES."""
    median, sidebar = geometry(words)
    x1, y1, x2, y2 = words.numbers("x1", "y1", "x2", "y2")
    yc, h, side = (y1 + y2) / 2, doubles(words.column("h_px"))[words.page], sidebar[words.page]
    return median, sidebar, np.select([yc < 0.12 * h, yc > 0.92 * h, (side != -1) & ((x1 + x2) / 2 < side)], [0, 3, 1], 2)


def zone_words(own: list[str]):
    """For mapInArrow: the words as rows (page_id, own, zone)."""
    def step(batch):
        words = Words(batch)
        _, _, zone = zoned(words)
        page = words.column("page_id").take(pa.array(words.page))
        return pa.RecordBatch.from_arrays([page, *(words.field(c) for c in own), pa.array(ZONES).take(pa.array(zone))], names=["page_id", *own, "zone"])

    return apply(step)


def _rows(words: Words) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows in order: the page and the zone, as page times the number of zones plus its place in ZONES, the row's number, its text."""
    median, _, zone = zoned(words)
    seq, x1, y1, x2, y2 = words.numbers("seq", "x1", "y1", "x2", "y2")
    yc, key = (y1 + y2) / 2, words.page * len(ZONES) + zone
    text = words.field("text")
    order = np.lexsort((first(seq), first(yc), key))
    parts, sizes = np.unique(key, return_counts=True)
    row = np.empty(len(key), np.int64)
    row[order] = fold(sizes, yc[order], 0.65 * median[parts // len(ZONES)], False, True)
    order = sorted_by(text, key, row, first(x1), first(yc), first(seq), first(x2))
    key, row, x1, x2, text = key[order], row[order], x1[order], x2[order], text.take(pa.array(order))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
    gap = np.where(new, np.nan, x1 - np.concatenate([[np.nan], x2[:-1]])) if len(key) else x1
    bar = (key % len(ZONES) == 2) & (gap > 0.035 * doubles(words.column("w_px"))[key // len(ZONES)])
    between = pa.array(["", " ", "   |   "]).take(pa.array(np.where(np.isnan(gap), 0, np.where(bar, 2, 1))))
    begins = np.flatnonzero(new)
    text = joined(pc.binary_join_element_wise(between, text, ""), np.diff(np.append(begins, len(key))), "")
    return key[begins], row[begins], pc.utf8_trim(text, WHITE)


def _zone_rows(batch):
    words = Words(batch)
    key, row, text = _rows(words)
    page, zone = words.column("page_id").take(pa.array(key // len(ZONES))), pa.array(ZONES).take(pa.array(key % len(ZONES)))
    return pa.RecordBatch.from_arrays([page, zone, pa.array(row, pa.int32()), text], names=["page_id", "zone", "row_no", "row_text"])


zone_rows = apply(_zone_rows)


def _tagged(batch):
    words = Words(batch)
    key, _, text = _rows(words)
    parts, many = np.unique(key, return_counts=True)
    zone = pc.binary_join_element_wise("<", pa.array(ZONES).take(pa.array(parts % len(ZONES))), ">\n  ", joined(text, many, "\n  "), "")
    pages, many = np.unique(parts // len(ZONES), return_counts=True)
    block = pc.binary_join_element_wise("\n<PAGE 1>\n", joined(zone, many, "\n"), "")
    return pa.RecordBatch.from_arrays([words.column("page_id").take(pa.array(pages)), block], names=["page_id", "tagged"])


tagged_text = apply(_tagged)
