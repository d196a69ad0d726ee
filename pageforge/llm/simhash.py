"""Near duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints of 64 bits are split into parts of correlated bits. If thresholds t_i of m parts sum to
max_distance - m + 1, then two fingerprints that differ in at most max_distance bits differ in at most t_i bits of some
part i. The parts' number and thresholds are chosen by dynamic programming on candidate counts estimated from a bounded
sample; that choice changes the cost and never the result. Every distinct fingerprint then puts itself under its probe
keys, keys are shuffled, and each bucket is verified exactly.

Near copies by similarity (`drop_near_copies`): 64 bits can't tell texts that share 80 % of their shingles, some 10 bits
apart, from others at a cost that holds at scale. So a longer fingerprint, of WORDS * 64 bits over five-word shingles, is
cut into parts of correlated bits in the same way; dynamic programming picks the parts and their thresholds, with least
estimated cost, so that a pair of exactly the wanted similarity meets in some part but for a chance of MISS (more
similar pairs meet more surely). Members of a bucket within CHECK_DISTANCE of CHECK * 64 further bits are candidates, and
a bucket gives only as many pairs as join them. Fingerprints of few shingles differ by chance, so texts of up to SHORT
shingles are found exactly instead, by their rarest shingles. What candidates join is a group; a group's texts travel
to one task once, or in chunks that meet in pairs where there are many, and each is held against all others there that
aren't joined yet, exactly, on the shingles of both.

Defined results: a null or blank text has fingerprint 0, which links like any other; equal fingerprints are one class;
links are between fingerprints, so rows without an id link others too, and rows that repeat a doc_id each get a result
row with the component of their own text; a component whose rows have no id has none; other columns are ignored; an
empty table gives an empty result. Near copies: null and blank texts are copies of each other, as are texts that differ
in white space or ASCII case only; groups are connected components; of each group the row with the smallest doc_id
stays, rows without an id last; of rows with equal ids and texts one stays, a different text never goes for an id that
it shares.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import slices, union_all
from pageforge.storage import forget, stored

SEED, SHINGLE = 42, 4
#: Fingerprints of the sample from which bits are grouped and candidates are estimated; results don't depend on it.
SAMPLE = 4096
#: Members from which on a bucket is dealt again under narrower keys.
BUCKET = 20_000
#: Rows that are compared at once; members of a bucket up to which its pairs are compared together with other buckets'.
BATCH, SMALL = 200_000, 32


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; a shorter text is one shingle, without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[size:])], np.uint64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    hashes = shingle_hashes(text, SHINGLE)
    total, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, total, 8192):
        ones += bits_of(hashes[k : k + 8192, None]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long of the same bits."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words (one or several a row) as rows of zeros and ones, lowest bit first."""
    width = 8 * (fps.shape[1] if fps.ndim > 1 else 1)
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), width), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Parts of the given sizes of a sample's bits (one column each), each of bits that go together most."""
    bits = sample.astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    related = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = np.ones(sample.shape[1], bool), []
    for size in sizes:
        group = [int(np.argmax(free))]
        free[group[0]] = False
        near = related[group[0]].copy()
        while len(group) < size:
            best = int(np.argmax(np.where(free, near, -1.0)))
            free[best] = False
            group.append(best)
            near += related[best]
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def probes(group: list[int], threshold: int) -> list[int]:
    """Masks that keep the part's bits but for any `threshold` of them: fingerprints within it agree under some mask."""
    return [] if threshold < 0 else [mask_of(set(group) - set(left)) for left in combinations(group, threshold)]


def allocate(groups: list[list[int]], sample: np.ndarray, total: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds for the parts with least estimated cost, and that cost; they sum to distance - parts + 1.

    Cost: keys sent, plus pairs met in buckets, scaled from the sample's pairs to all `total` fingerprints.
    """
    half = len(sample) // 2
    a, b = sample[:half], sample[half : 2 * half]
    both = np.concatenate([np.roll(b, k) ^ a for k in range(min(half, 256))]) if half else np.zeros(0, np.uint64)
    pairs = total * (total - 1) / 2
    most = distance // len(groups) + 1
    cost = {}
    for i, group in enumerate(groups):
        apart = np.bitwise_count(both & np.uint64(mask_of(group)))
        for t in range(-1, most + 1):
            keys = math.comb(len(group), t) if t >= 0 else 0
            # a smoothed rate: the uniform one where the sample has no such pair
            even = sum(math.comb(len(group), d) for d in range(t + 1)) / 2 ** len(group)
            rate = ((apart <= t).sum() + even) / (len(both) + 1) if t >= 0 else 0
            cost[i, t] = keys * total * 12 + rate * pairs * max(1, t + 1) if t >= 0 else 0.0
    best = {0: (0.0, [])}
    for i in range(len(groups)):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, most + 1):
                if used + t not in new or new[used + t][0] > c + cost[i, t]:
                    new[used + t] = (c + cost[i, t], [*ts, t])
        best = new
    return best[distance - len(groups) + 1]


def plan(sample: np.ndarray, total: int, distance: int) -> list[list[int]]:
    """For each part that takes part: its probe masks."""
    found = []
    for parts in range(min(3, distance + 1), distance + 2):
        groups = group_bits(bits_of(sample), [(64 + k) // parts for k in range(parts)])
        cost, thresholds = allocate(groups, sample, total, distance)
        found.append((cost, parts, [probes(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join whatever links of at most `distance` bits join, without listing all pairs."""
    left, edges = np.arange(1, len(members)), []
    queue = [0]
    while len(left):
        at = queue.pop() if queue else -1
        if at < 0:
            at, left = left[0], left[1:]
        near = np.bitwise_count(members[left] ^ members[at]) <= distance
        if near.any():
            hit = left[near]
            edges += [(at, x) for x in hit.tolist()]
            queue += hit.tolist()
            left = left[~near]
    return edges


def _buckets(batches, most: int | None):
    """(kind, columns) of the buckets that have several members, from batches sorted by the first column: "small" is any
    number of buckets of up to SMALL members, "whole" is one, "part" a part of one above `most` members (None: no such
    bound), so that memory stays bounded."""
    kept, over = None, None
    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        if over is not None:
            cut = int(np.searchsorted(now[0], over, side="right"))
            if cut:
                yield "part", now[:, :cut]
            now = now[:, cut:]
        if kept is not None:
            now = np.concatenate([kept, now], axis=1)
        if not now.shape[1]:
            continue
        over, kept = None, None
        starts = np.flatnonzero(np.r_[True, now[0, 1:] != now[0, :-1]])
        sizes = np.diff(np.r_[starts, now.shape[1]])
        few = (sizes > 1) & (sizes <= SMALL)
        few[-1] = False
        if few.any():
            yield "small", now[:, np.repeat(few, sizes)]
        for k in np.flatnonzero(sizes[:-1] > SMALL):
            yield "part" if most is not None and sizes[k] > most else "whole", now[:, starts[k] : starts[k + 1]]
        kept = now[:, starts[-1] :]
        if most is not None and sizes[-1] > most:
            yield "part", kept
            over, kept = kept[0, 0], None
    if kept is not None and kept.shape[1] > 1:
        yield "whole", kept


def _verify(distance: int, most: int | None):
    """(kind, u, v, w) of rows (key, fp, node) sorted by key: links (0, u, v, 0), and the members of buckets that are
    too large (1, key, fp, node)."""

    def run(batches):
        found, rows = [], 0
        for kind, (key, fp, node) in _buckets(batches, most):
            fps = fp.view(np.uint64)
            if kind == "part":
                found.append(np.stack([np.ones(len(key), np.int64), key, fp, node]))
            else:
                if kind == "small":
                    pairs = []
                    for shift in range(1, SMALL):
                        at = np.flatnonzero(key[shift:] == key[:-shift])
                        if not len(at):
                            break
                        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
                        pairs.append(np.stack([at, at + shift]))
                    i, j = np.concatenate(pairs, axis=1)
                else:
                    i, j = np.array(_forest(fps, distance), np.int64).reshape(-1, 2).T
                a, b = node[i], node[j]
                found.append(np.stack([np.zeros(len(a), np.int64), np.maximum(a, b), np.minimum(a, b), np.zeros(len(a), np.int64)]))
            rows += found[-1].shape[1]
            if rows > BATCH:
                yield _columns(found, ("kind", "u", "v", "w"))
                found, rows = [], 0
        if found:
            yield _columns(found, ("kind", "u", "v", "w"))

    return run


def _columns(found: list[np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    rows = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "kind" else pa.int64()) for x, n in zip(rows, names)], names=list(names))


def deal_again(large: DataFrame, limit: int) -> DataFrame:
    """Rows (key, node, ...) of buckets too large for a task, under keys of smaller ones: a bucket's members are cut into
    chunks of about half the limit, and every two chunks meet under a key of their own, so no pair is lost."""
    sizes = large.groupBy("key").count().select("key", F.ceil(F.col("count") * 2 / limit).cast("int").alias("_c"))
    cut = large.join(sizes, "key").withColumn("_a", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int"))
    met = cut.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    key = F.xxhash64("key", F.least("_a", "_b"), F.greatest("_a", "_b"))
    return met.withColumn("key", key).drop("_a", "_b", "_c")


def links(classes: DataFrame, distance: int, sample_rows: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v: links between representatives of fingerprint classes (fp, rep); together they join all that
    links of at most `distance` bits join."""
    total = classes.count()
    rows = classes.orderBy(F.xxhash64("fp")).limit(sample_rows).select("fp").toPandas()["fp"].to_numpy(np.int64)
    parts = plan(rows.view(np.uint64), total, distance)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)) for part in parts for m in part])
    keyed = classes.select("fp", "rep", F.posexplode(masks).alias("_n", "_mask")).select(
        F.xxhash64("_n", F.col("fp").bitwiseAND(F.col("_mask"))).alias("key"), "fp", F.col("rep").alias("node")
    )
    schema = "kind int, u long, v long, w long"
    sorted_ = lambda df: df.select("key", "fp", "node").repartition("key").sortWithinPartitions("key")
    found = stored(sorted_(keyed).mapInArrow(_verify(distance, bucket), schema), "simhash-links")
    large = found.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("fp"), F.col("w").alias("node"))
    found = found.where("kind = 0")
    if not large.isEmpty():
        found = found.unionByName(sorted_(deal_again(large, bucket)).mapInArrow(_verify(distance, None), schema))
    return found.select("u", "v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each other node of edges (u, v); alternating large and small
    stars."""
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = stamp(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(last)
        now = stamp(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most `distance` differing bits."""
    marked = stored(fingerprints(docs), "simhash")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linked = components(links(classes.select("fp", F.col("fp").alias("rep")), distance))
    settled = stored(classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "simhash-groups")
    least = settled.groupBy("group").agg(F.min("least").alias("component_id"))
    return marked.join(settled.join(least, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Near copies: words of a shingle, least similarity as a fraction, 64-bit words of the fingerprint that keys are made of
#: and that candidates are checked on, chance to miss a pair of the least similarity.
NEAR_SHINGLE, SIMILAR, WORDS, CHECK, MISS = 5, (4, 5), 16, 2, 0.01
#: Shingles up to which a text's near copies are found exactly: fingerprints of few shingles differ by chance.
SHORT = 32
#: Members and shingles of a group whose texts are compared in one task; a larger one is cut into chunks that meet in pairs.
TOGETHER, SHINGLES = 1000, 1 << 19
#: Bytes of a table of bits that a comparison uses; where more would be needed, it goes over lists.
BITS = 1 << 23
#: Texts with a candidate whose hashes are broadcast at most.
MAX_NODES = 4_000_000
#: Estimated cost of a key, in compared pairs.
KEY = 100
#: Bits apart, as a share, at the least similarity: the angle between sets of equal size.
APART = math.acos(2 * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1])) / math.pi
#: Bits of the check words in which candidates may differ: three deviations more than the mean at that similarity.
CHECK_DISTANCE = int(64 * CHECK * APART + 3 * math.sqrt(64 * CHECK * APART * (1 - APART)))
_MIX = (np.arange(1, WORDS + CHECK + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def distinct_shingles(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, NEAR_SHINGLE))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Two sets of shingles share at least SIMILAR of all that either has; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def similar_forest(sets: list[np.ndarray], sizes: np.ndarray | None = None) -> np.ndarray:
    """Pairs (rows i, j) of similar sets that join whatever pairs of similar sets join. sizes, if given, are the sets'
    sizes before their members were cut to fewer bits: then the pairs may be some too many, but none is missing."""
    many, lengths = len(sets), np.array([len(s) for s in sets])
    sizes = lengths if sizes is None else sizes
    lost = sizes - lengths
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what only one set has adds to its size and to nothing that is shared
    shared = count > 1
    owner, kept = np.repeat(np.arange(many), lengths), shared[place]
    owner, place, width = owner[kept], (np.cumsum(shared) - 1)[place[kept]], int(shared.sum())
    words = -(-width // 64)
    if many * words * 8 <= BITS:
        table = np.zeros((many, words), np.uint64)
        np.bitwise_or.at(table, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        overlap = lambda at, left: np.bitwise_count(table[left] & table[at]).sum(axis=1, dtype=np.int64)
    else:
        starts, mark = np.searchsorted(owner, np.arange(many + 1)), np.zeros(width, bool)

        def overlap(at: int, left: np.ndarray) -> np.ndarray:
            mark[place[starts[at] : starts[at + 1]]] = True
            found = np.bincount(owner[mark[place]], minlength=many)[left]
            mark[place[starts[at] : starts[at + 1]]] = False
            return found

    left, queue, edges = np.arange(1, many), [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        both = overlap(at, left) + np.minimum(lost[at], lost[left])
        near = SIMILAR[1] * both >= SIMILAR[0] * (sizes[at] + sizes[left] - both)
        hit, left = left[near], left[~near]
        edges += [(at, x) for x in hit.tolist()]
        queue += hit.tolist()
    return np.array(edges, np.int64).reshape(-1, 2).T


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS + CHECK words of SimHash bits of a set of shingles; each word takes its own bits from a shingle's hash."""
    ones = np.zeros(64 * len(_MIX), np.int64)
    for k in range(0, len(hashes), 512):
        x = hashes[k : k + 512, None] * _MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        ones += bits_of(x).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _long(short: int | None):
    """(node, n, fp, few) of rows (node, text): the number of distinct shingles, the fingerprint where there are more than
    `short`, and the shingles themselves where a near copy may have no more than `short`. None: only shingles."""
    most = None if short is None else short * SIMILAR[1] // SIMILAR[0]

    def run(batches):
        for part in slices(batches):
            sets = [distinct_shingles(t) for t in part.column(1).to_pylist()]
            fps = [long_fingerprint(s).tobytes() if short is not None and len(s) > short else None for s in sets]
            few = [s.view(np.int64) if most is None or len(s) <= most else None for s in sets]
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "fp", "few"])

    return run


def within(width: int, threshold: int, apart: float) -> float:
    """The chance that at most `threshold` of a part's bits differ, each with the chance `apart`."""
    return sum(math.comb(width, d) * apart**d * (1 - apart) ** (width - d) for d in range(threshold + 1))


def choose_parts(bits: np.ndarray, total: int, miss: float = MISS, unit: float = 0.02) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that make keys, for `total` fingerprints of which `bits` is a sample."""
    need = math.ceil(-math.log(miss) / unit)
    half = len(bits) // 2
    turns = min(half, 8)
    pairs, best = total * (total - 1) / 2, (math.inf, [])
    for width in (6, 8, 10, 12, 14, 16, 20, 24, 28, 32):
        groups = group_bits(bits, [width] * (bits.shape[1] // width))
        # for each number of steps towards the wanted chance: the least cost, and the thresholds that have it
        states: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for group in groups:
            apart = np.concatenate([(np.roll(bits[half : 2 * half, group], k, axis=0) ^ bits[:half, group]).sum(axis=1) for k in range(turns)] or [np.zeros(0)])
            new = dict(states)
            for t in (0, 1):
                even = within(width, t, 0.5)
                rate = (float((apart <= t).sum()) + even) / (len(apart) + 1)
                cost = math.comb(width, t) * total * KEY + rate * pairs * (t + 1)
                step = int(-math.log(1 - within(width, t, APART)) / unit)
                for used, (spent, chosen) in states.items():
                    now = min(need, used + step)
                    if now not in new or new[now][0] > spent + cost:
                        new[now] = (spent + cost, [*chosen, (group, t)])
            states = new
        if need in states and states[need][0] < best[0]:
            best = states[need]
    return best[1]


def _keys(parts: list[tuple[list[int], int]]):
    """(key, node, n, c, d) of rows (node, n, fp): a key for each part, with each of its bits left out where it may differ."""

    def run(batches):
        for batch in slices(batches, 1024):
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(batch.num_rows, WORDS + CHECK)
            bits, found = bits_of(words), []
            for k, (group, t) in enumerate(parts):
                value = bits[:, group].astype(np.uint64) @ (np.uint64(1) << np.arange(len(group), dtype=np.uint64))
                for j in range(len(group)) if t else (-1,):
                    kept = value if j < 0 else value & ~(np.uint64(1) << np.uint64(j))
                    x = kept * np.uint64(0x9E3779B97F4A7C15) + np.uint64((64 * k + j + 1) * 0x9FB21C651E98DF25 % 2**64)
                    x ^= x >> np.uint64(32)
                    found.append(x * np.uint64(0xD6E8FEB86659FD93))
            if not found:
                continue
            own = [
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False),
                words[:, WORDS].view(np.int64), words[:, WORDS + 1].view(np.int64),
            ]
            rows = [np.stack(found, axis=1).ravel().view(np.int64), *(np.repeat(x, len(found)) for x in own)]
            for a in range(0, len(rows[0]), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + BATCH]) for x in rows], names=["key", "node", "n", "c", "d"])

    return run


def _may(n, c, d, i, j) -> np.ndarray:
    """Which of the pairs (i, j) may be near copies, by their numbers of shingles and the check words."""
    apart = np.bitwise_count((c[i] ^ c[j]).view(np.uint64)) + np.bitwise_count((d[i] ^ d[j]).view(np.uint64))
    return (apart <= CHECK_DISTANCE) & (SIMILAR[1] * np.minimum(n[i], n[j]) >= SIMILAR[0] * np.maximum(n[i], n[j]))


def _joined(n: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join whatever pairs of members that may be near copies join."""
    left, queue, edges = np.arange(1, len(n)), [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = _may(n, c, d, at, left)
        hit, left = left[near], left[~near]
        edges += [(at, x) for x in hit.tolist()]
        queue += hit.tolist()
    return edges


def _candidates(most: int | None):
    """(kind, key, node, n, c, d) of rows (key, node, n, c, d) sorted by key: pairs (0, u, v, 0, 0, 0) that join all that
    may be near copies, and members (1, key, ...) of buckets too large."""

    def run(batches):
        found, rows = [], 0
        for kind, bucket in _buckets(batches, most):
            key, node, n, c, d = bucket
            if kind == "part":
                found.append(np.concatenate([np.ones((1, len(key)), np.int64), bucket]))
            else:
                if kind == "small":
                    pairs = [np.zeros((2, 0), np.int64)]
                    for shift in range(1, SMALL):
                        at = np.flatnonzero(key[shift:] == key[:-shift])
                        if not len(at):
                            break
                        at = at[_may(n, c, d, at, at + shift)]
                        pairs.append(np.stack([at, at + shift]))
                    i, j = np.concatenate(pairs, axis=1)
                else:
                    i, j = np.array(_joined(n, c, d), np.int64).reshape(-1, 2).T
                u, v, zero = node[i], node[j], np.zeros(len(i), np.int64)
                found.append(np.stack([zero, np.minimum(u, v), np.maximum(u, v), zero, zero, zero])[:, u != v])
            rows += found[-1].shape[1]
            if rows > BATCH:
                yield _columns(found, ("kind", "key", "node", "n", "c", "d"))
                found, rows = [], 0
        if found:
            yield _columns(found, ("kind", "key", "node", "n", "c", "d"))

    return run


def _by_group(batches):
    """(rows of one group) after the other, from batches sorted by their first column, as lists of columns."""
    kept: list[list] = []
    for rows in slices(batches):
        key = rows.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            part = [rows.column(x).slice(a, b - a).to_pylist() for x in range(rows.num_columns)]
            if kept and kept[0][0] != part[0][0]:
                yield kept
                kept = []
            kept = [x + y for x, y in zip(kept, part)] if kept else part
    if kept:
        yield kept


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verified(whole: bool):
    """(u, v), u < v, of similar texts, which join all similar ones of a group, from rows sorted by their first column:
    (key, node, text), or (key, node, few, n) with 16 bits of each of a text's n shingles, which may give some too many."""

    def run(batches):
        found: list[tuple[int, int]] = []
        for _, node, own, *n in _by_group(batches):
            if len(node) > 1:
                sets = [distinct_shingles(t) for t in own] if whole else [np.unique(np.array(f, np.int32)) for f in own]
                pairs = similar_forest(sets, *(np.array(x) for x in n))
                found += [(min(node[i], node[j]), max(node[i], node[j])) for i, j in pairs.T.tolist() if node[i] != node[j]]
            if len(found) > 20_000:
                yield _links(found)
                found = []
        if found:
            yield _links(found)

    return run


def in_chunks(rows: DataFrame, members: int, weight: str = "0", most: int = SHINGLES) -> DataFrame:
    """Rows (key, node, ...) of groups of two or more; groups above `members` rows, or above `most` of `weight`, under keys
    of smaller ones: their rows are cut into chunks of about half of that, and every two chunks meet under a key."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("_k"), F.sum(F.expr(weight)).alias("_w")).where("_k > 1")
    chunks = F.when((F.col("_k") <= members) & (F.col("_w") <= most), 1).otherwise(F.greatest(F.ceil(F.col("_k") * 2 / members), F.ceil(F.col("_w") * 2 / most)))
    cut = rows.join(sizes.select("key", chunks.cast("int").alias("_c")), "key").withColumn("_a", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int"))
    met = cut.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    key = F.when(F.col("_c") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_a", "_b"), F.greatest("_a", "_b")))
    return met.withColumn("key", key).drop("_a", "_b", "_c")


def _few_pairs(marked: DataFrame, members: int) -> DataFrame:
    """(u, v) that join all near copies among rows (node, n, few). Two sets that share SIMILAR of what they have share one
    of the rarest n - SIMILAR * n + 1 shingles of each, so these are keys; texts without words share a key of their own."""
    few = marked.where("few IS NOT NULL").select("node", "n", "few")
    each = few.select("node", F.explode("few").alias("h"))
    count = each.groupBy("h").agg(F.count("*").alias("c"))
    sorted_ = each.join(count, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("o"))  # one text's shingles
    need = f"(size(o) * {SIMILAR[0]} + {SIMILAR[1] - 1}) div {SIMILAR[1]}"
    keys = sorted_.select("node", F.explode(F.expr(f"filter(slice(o, 1, CAST(size(o) - {need} + 1 AS INT)), x -> x.c > 1)")).alias("x")).select("node", F.col("x.h").alias("key"))
    keys = keys.unionByName(few.where("n = 0").select("node", F.lit(0).cast("long").alias("key")))
    rows = keys.join(few, "node").select("key", "node", F.expr("transform(few, h -> CAST(h & 65535 AS INT))").alias("few"), "n")
    dealt = in_chunks(rows, members).select("key", "node", "few", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_verified(False), "u long, v long")


def _with_roots(found: DataFrame) -> DataFrame:
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def near_copies(
    texts: DataFrame, miss: float = MISS, sample_rows: int = SAMPLE, bucket: int = BUCKET, members: int = TOGETHER, short: int | None = SHORT
) -> DataFrame:
    """(node, component) of the texts (node, text; node is a hash of the text) that have a near copy. With short=None all
    texts go the exact way, whose cost grows with the square of a text's length."""
    read = texts.select("node", "text").mapInArrow(_long(short), "node long, n long, fp binary, few array<long>")
    marked = stored(read.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "few")]), "near-fingerprints")
    tables, pairs = [marked], [_few_pairs(marked, members)]
    if short is not None:
        long_ = marked.where("fp IS NOT NULL").select("node", "n", "fp")
        total = long_.count()
        sample = [r[0] for r in long_.orderBy(F.xxhash64("node")).limit(sample_rows).select("fp").collect()]
        words = np.frombuffer(b"".join(sample), "<u8").reshape(len(sample), WORDS + CHECK)[:, :WORDS]
        parts = choose_parts(bits_of(words) if sample else np.zeros((0, 64 * WORDS), np.uint8), total, miss)
        names = ["key", "node", "n", "c", "d"]
        schema = "kind int, key long, node long, n long, c long, d long"
        # in the order of nodes, so that all buckets join a group to the same member
        dealt = lambda df: df.select(*names).repartition("key").sortWithinPartitions("key", "node")
        keyed = long_.mapInArrow(_keys(parts), "key long, node long, n long, c long, d long")
        found = stored(dealt(keyed).mapInArrow(_candidates(bucket), schema), "near-candidates")
        tables.append(found)
        large = found.where("kind = 1").select(names)
        if not large.isEmpty():
            tables.append(stored(dealt(deal_again(large, bucket)).mapInArrow(_candidates(None), schema), "near-candidates"))
        pairs += [t.where("kind = 0").select(F.col("key").alias("u"), F.col("node").alias("v")) for t in tables[1:]]
    # groups of texts that candidates join; all pairs within a group are held against each other, with the texts
    group = stored(_with_roots(components(union_all(pairs))), "near-groups")
    asked = in_chunks(group.join(marked.select("node", "n"), "node").select(F.col("component").alias("key"), "node", "n"), members, "n")
    nodes = group.select("node")
    # eight bytes each; with more of them, texts are shuffled
    few = F.broadcast(nodes) if nodes.count() <= MAX_NODES else nodes
    text = texts.join(few, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    met = asked.join(text, "node").select("key", "node", "text").repartition("key").sortWithinPartitions("key")
    links_ = stored(met.mapInArrow(_verified(True), "u long, v long"), "near-links")
    result = stored(_with_roots(components(links_)), "near-copies")
    for done in (*tables, group, links_):
        forget(done)
    return result


def drop_near_copies(docs: DataFrame, miss: float = MISS, exact: bool = False) -> DataFrame:
    """Of each group of near copies, one row of docs: the smallest doc_id's. A row is known by its id and text, a text by
    two hashes; texts that share the first of them and not the second are no copies and stay."""
    plain = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_node": F.xxhash64(plain), "_check": F.xxhash64(F.lit(1), plain)})
    twice = rows.groupBy("_node").agg(F.min("_check").alias("a"), F.max("_check").alias("b")).where("a <> b").select("_node")
    alone = stored(twice, "near-hashes")
    known = rows if alone.isEmpty() else rows.join(alone, "_node", "left_anti")
    found = near_copies(known.select(F.col("_node").alias("node"), "text"), miss, short=None if exact else SHORT)
    placed = rows.select("doc_id", F.col("_node").alias("node"), F.col("_check").alias("check")).join(found, "node", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "check")).alias("w")
    own = F.when(F.col("component").isNull(), F.col("check"))  # a text without near copies is its own group
    first = placed.groupBy(F.coalesce("component", "node").alias("_g"), own.alias("_o")).agg(least)
    first = stored(first.select(F.col("w.doc_id").alias("_id"), F.col("w.node").alias("_n"), F.col("w.check").alias("_c")), "near-first")
    kept = rows.join(first, rows["_node"].eqNullSafe(first["_n"]) & rows["_check"].eqNullSafe(first["_c"]) & rows["doc_id"].eqNullSafe(first["_id"]), "left_semi")
    again = rows.groupBy("doc_id", "_node", "_check").count().where("count > 1").isEmpty()
    return (kept if again else kept.dropDuplicates(["doc_id", "_node", "_check"])).select(docs.columns)
