"""Exact top-k by inner product, by aggregation without random access.

Rows stay where they are. A task holds a bounded batch of queries and takes its rows block by block; a block is one list
per component, sorted by distance from the component's middle. A query reads the lists from their far ends, in rounds: a
round reads, of every list, the entries that can change a score by more than the round's step, so lists of large query
components and wide spread are read first and deepest; a list that a round reads for a good part is read to its end.
Every row keeps the sum of its entries that have been read, and the number of lists that still lack one; an entry that
hasn't been read changes the score by the step at most, which bounds the score from both sides. The bar is the k-th best
lower bound, or the k-th best final score of earlier blocks; rows whose upper bound is below it are outsiders. Reading
stops when no more rows are left than FEW of the block, or k; these get their final scores. On any data lists that bounds
don't end are read to the end, so results are exact. Each task gives k rows per query, and those are merged.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without
an id; ties go to the smaller id; fewer than k others give fewer rows; rows that repeat an id are one candidate each,
and each is excluded from that id's own query; queries that repeat an id share one list of k; other columns are ignored.
Vectors of unequal lengths are not compared. What does not fit 64 bits, a component or a score, is the largest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import materialize

#: Rows of a block, queries of a batch that is sent to all tasks, rows of a task at most.
BLOCK, QUERIES, ROWS = 8192, 16_384, 1 << 22
#: The share of a block's rows left at which reading stops; the first round's step as a share of what one entry can
#: change, and every other round's as a share of the one before; the share of a list from which it is read to its end.
FEW, FIRST, STEP, ON = 0.1, 0.08, 0.6, 0.1
LARGEST = 2**63 - 1


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether every partial sum is exact as a float."""
    peak = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1] * 2
    return peak < 2**51


class Search:
    """The best k rows so far of each query, over blocks of rows of one width. log: per query and block (rows, share of
    entries that were added, share of rows left)."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if queries.dtype == object else np.float64))
        self.log: list[tuple[int, float, float]] = []

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        bars = self._bars()
        if not _exact(x, self.queries):  # sums beyond what a float holds: all of them, as whole numbers
            scores = self.queries.astype(object) @ x.astype(object).T
            scores = np.minimum(np.maximum(scores, -LARGEST), LARGEST)
            of, at = np.nonzero((scores >= bars[:, None]) & (self.ids[:, None] != ids[None, :]))
            self.log += [(len(x), 1.0, 1.0)] * len(self.ids)
            self._merge(of, ids[at], scores[of, at])
            return
        middle = np.sort(x, axis=0)[len(x) // 2]
        apart = (x - middle).astype(np.float64)
        order = np.argsort(-np.abs(apart), axis=0, kind="stable").T.copy()  # one list a component, farthest first
        entry = np.take_along_axis(apart.T, order, axis=1)
        far = -np.abs(entry)
        columns = apart.T.copy()
        x, queries = x.astype(np.float64), self.queries.astype(np.float64)
        base, found = queries @ middle.astype(np.float64), []
        for k, q in enumerate(queries):
            left = self._read(q, base[k], bars[k], np.flatnonzero(ids == self.ids[k]), columns, order, entry, far)
            scores = x[left] @ q
            good = scores >= bars[k]
            found.append((np.full(int(good.sum()), k), ids[left[good]], scores[good]))
        if found:
            self._merge(*(np.concatenate(c) for c in zip(*found)))

    def _bars(self) -> np.ndarray:
        """Per query: its k-th best final score so far; minus infinity where there are fewer."""
        of, _, scores = self.found
        bars = np.full(len(self.ids), -np.inf, object if scores.dtype == object else np.float64)
        count = np.bincount(of, minlength=len(self.ids))
        last = np.cumsum(count) - 1
        full = count >= self.k  # kept sorted, best first
        bars[full] = scores[last[full]]
        return bars

    def _read(self, q: np.ndarray, base: float, bar: float, own: np.ndarray, columns: np.ndarray, order: np.ndarray, entry: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The rows that can still qualify when reading stops."""
        n = order.shape[1]
        lists = np.flatnonzero(q)
        weight = np.abs(q[lists])
        reach = -far[lists, 0] * weight
        if base + float(reach.sum()) < bar or n <= len(own):  # the heads of the lists
            self.log.append((n, 0.0, 0.0))
            return np.zeros(0, np.int64)
        sums, seen = np.full(n, base), np.zeros(n, np.int64)  # seen: lists that aren't read to the end but have shown the row
        sums[own] = -np.inf
        open_, done = dict(zip(lists.tolist(), weight.tolist())), dict.fromkeys(lists.tolist(), 0)
        own_bar = n - len(own) >= self.k and not np.isfinite(float(bar))  # no earlier block has given a better one
        step, added, few = float(reach.max(initial=0)) * FIRST, 0, max(self.k, int(FEW * n))
        while True:
            step = step if step >= 1 else 0.0  # whole numbers: under 1 all entries count
            for c, w in list(open_.items()):
                a, b = done[c], int(np.searchsorted(far[c], -step / w)) if step else n
                if b <= a:
                    continue
                if b > ON * n:
                    if a:
                        seen[order[c, :a]] -= 1
                        rows = order[c, a:]
                        sums[rows] += q[c] * entry[c, a:]
                    else:
                        sums += q[c] * columns[c]
                    del open_[c]
                    added += n - a
                else:
                    rows = order[c, a:b]
                    sums[rows] += q[c] * entry[c, a:b]
                    seen[rows] += 1
                    done[c], added = b, added + b - a
            apart = step * (len(open_) - seen)
            if own_bar:
                lower = sums - apart
                bar = max(bar, float(np.partition(lower, n - self.k)[n - self.k]))
            left = np.flatnonzero(sums + apart > bar - 0.5)  # scores are whole numbers, bounds may be rounded
            if len(left) <= few or not open_:
                left = left[np.isfinite(sums[left])]
                self.log.append((n, added / max(1, n * len(lists)), len(left) / n))
                return left
            step *= STEP

    def _merge(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.found
        of, ids = np.concatenate([old[0], of]), np.concatenate([old[1], ids])
        exact = object if scores.dtype == object or old[2].dtype == object else np.float64
        scores = np.concatenate([old[2].astype(exact), scores.astype(exact)])
        order = np.lexsort((ids, -scores, of)) if exact is not object else np.array(sorted(range(len(of)), key=lambda i: (of[i], -scores[i], ids[i])), np.int64)
        of, ids, scores = of[order], ids[order], scores[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        self.found = (of[keep], ids[keep], scores[keep])

    def best(self):
        """(query ids, row ids, scores) of what is best."""
        of, ids, scores = self.found
        return self.ids[of], ids, scores.astype(np.int64)


def by_width(ids: pa.Array, vectors: pa.ListArray):
    """(ids, matrix) of the vectors of each width."""
    starts = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    widths, of = np.diff(starts), ids.to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield int(width), of[rows], values[starts[:-1][rows][:, None] + np.arange(width)]


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, block: int):
    def run(batches):
        searches = {w: Search(*q, k) for w, q in queries.items()}
        waiting: dict[int, list] = {w: [] for w in queries}

        def work(w: int, least: int) -> None:
            ids, x = (np.concatenate(c) for c in zip(*waiting[w]))
            while len(ids) >= least and len(ids):
                searches[w].block(ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
            waiting[w] = [(ids, x)] if len(ids) else []

        for batch in batches:
            for w, ids, x in by_width(batch.column(0), batch.column(1)):
                if w in queries:
                    waiting[w].append((ids, x))
                    if sum(len(i) for i, _ in waiting[w]) >= block:
                        work(w, block)
        for w, search in searches.items():
            if waiting[w]:
                work(w, 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in search.best()], names=["query_id", "vec_id", "score"])

    return run


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * component), component as double."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    )
    return table.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_batch: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of `vectors` for each row of `queries`; both are (id, v).

    Rows are never shuffled; what travels is each batch of queries (of about query_batch rows, dealt by hash) to every
    task, and k rows per query and task back. One batch after the other is a job of its own.
    """
    spark = vectors.sparkSession
    queries = materialize(queries.select("id", "v").distinct(), "topk-queries")
    n, m = vectors.count(), queries.count()
    batches = max(1, -(-m // query_batch))
    if batches > 1:
        vectors = materialize(vectors.select("id", "v"), "topk-rows")
    tasks = max(-(-n // ROWS), min(spark.sparkContext.defaultParallelism, -(-n // block)), 1)
    rows, parts = vectors.select("id", "v").coalesce(tasks), []
    dealt = queries.withColumn("_b", F.pmod(F.xxhash64("id", "v"), F.lit(batches)))
    for b in range(batches):
        table = dealt.where(F.col("_b") == b).select("id", "v").toArrow().combine_chunks()
        of = {w: (ids, x) for w, ids, x in by_width(table.column(0).combine_chunks(), table.column(1).combine_chunks())} if table.num_rows else {}
        part = rows.mapInArrow(_search(of, k, block), "query_id long, vec_id long, score long")
        parts.append(materialize(part, "topk-part") if batches > 1 else part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
