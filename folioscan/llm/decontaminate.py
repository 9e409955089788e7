"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _BASE, buffers, finishing, mix, row_groups, words
from .workspace import arrow_rows, fresh

BLOCKS = 8
UNIT = 1 << 12
SCHEMA = "{id} {kind}, item_id long, similarity double, distance int, word_start long, n_words int"


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, row ends ignored."""
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + h[k : k + len(total)]
    return mix(total)


def fingerprints(s: np.ndarray, size: int, n: np.ndarray | None = None) -> np.ndarray:
    """64-bit SimHash of every window of ``size`` consecutive shingles.

    ``n`` holds how many items have each shingle, 0 for none: then a shingle counts by the
    root of 1 / n, and one of no item by the root of the mean 1 / n of its window. Roots make
    the angle between two windows follow their weighted similarity. All sums are integers, so
    equal windows print alike wherever they stand.
    """

    def over(x: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(s) + 1, *x.shape[1:]), np.int64)
        np.cumsum(x, axis=0, out=sums[1:])
        return sums[size:] - sums[:-size]

    signs = 2 * ((s[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) - 1
    if n is None:
        sums = over(signs)
    else:
        known, share = n > 0, 1 / np.maximum(n, 1)
        root = np.where(known, np.maximum(1, np.rint(UNIT * np.sqrt(share))), 0).astype(np.int64)
        mean = over(np.where(known, UNIT * UNIT * share, 0).astype(np.int64)) / np.maximum(1, over(known.astype(np.int64)))
        other = np.maximum(1, np.rint(np.sqrt(mean))).astype(np.int64)
        sums = over(signs * root[:, None]) + other[:, None] * over(signs * ~known[:, None])
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class ItemIndex:
    """Benchmark items, ready to be sent to workers: some 30 bytes for each of their words.

    ``often`` lists the shingles that more than one different item of the whole benchmark
    holds, with how many; a shingle's weight is 1 over that number. Of two fingerprints within
    ``radius`` one of their 8 blocks of 8 bits differs in at most radius // 8 bits. So an item
    of so many words stands, for each block, in the buckets of all values within that of its
    own, and a window reads for each block the bucket of its value: what these hold are its
    candidates, and none within the radius is missed. A bucket is a row of bits, one an item.
    Windows are printed without weights and, where these differ, with them: either may find.
    """

    def __init__(self, items: list[tuple[int, str]], often: tuple[np.ndarray, np.ndarray], shingle: int, radius: int, threshold: float):
        self.shingle, self.radius, self.threshold = shingle, radius, threshold
        data, off = buffers(pa.array([t for _, t in items], pa.string()))
        h, at, _, _ = words(data, off, lower=True)
        long = np.diff(at) > 0
        self.ids = [i for (i, _), full in zip(items, long, strict=True) if full]
        self.length = np.diff(at)[long]
        all_shingles = [runs(h[a:b], min(shingle, int(b - a))) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
        self.bags = [np.unique(s, return_counts=True) for s in all_shingles]
        every = np.concatenate([b for b, _ in self.bags]) if self.bags else np.zeros(0, np.uint64)
        own = np.unique(every)
        self.known = np.union1d(own, often[0])
        self.n = np.ones(len(self.known), np.int32)
        self.n[np.searchsorted(self.known, often[0])] = often[1]
        place = np.searchsorted(self.known, every)
        self.holder = np.repeat(np.arange(len(self.bags)), [len(b) for b, _ in self.bags])[np.argsort(place, kind="stable")].astype(np.int32)
        self.first = np.searchsorted(np.sort(place), np.arange(len(self.known) + 1)).astype(np.int32)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[own & np.uint64((1 << 20) - 1)] = True
        self.near = np.array([[(a ^ b).bit_count() <= radius // BLOCKS for a in range(256)] for b in range(256)])
        self.prints = [np.array([fingerprints(s, len(s), self.holders(s) if weighted else None)[0] for s in all_shingles], np.uint64) for weighted in (False, True)]
        if len(np.unique(self.n)) < 2:
            self.prints.pop()
        self.fewest = np.array([self._fewest(*bag) for bag in self.bags], np.int64)
        self.of_length = {int(m): np.flatnonzero(self.length == m) for m in np.unique(self.length)}
        self.buckets = {m: [self._buckets(prints[of]) for prints in self.prints] for m, of in self.of_length.items()}

    def _buckets(self, prints: np.ndarray) -> np.ndarray:
        """(block, value, bits): which of the items stand in the bucket of a block's value."""
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        return np.stack([np.packbits(self.near[:, blocks[:, b]], axis=1) for b in range(BLOCKS)])

    def holders(self, s: np.ndarray) -> np.ndarray:
        """How many items hold each shingle; 0 for those of one item elsewhere, or of none."""
        at, found = self.find(s)
        return np.where(found, self.n[at], 0) if len(self.known) else np.zeros(len(s), np.int64)

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, s), max(0, len(self.known) - 1))
        return at, (self.known[at] == s) if len(self.known) else np.zeros(len(s), bool)

    def _fewest(self, b: np.ndarray, m: np.ndarray) -> int:
        """The least number of shingles with which a text can reach the threshold: its
        heaviest ones. Without weights no fewer would do."""
        heavy = np.cumsum(np.sort(np.repeat(1 / self.holders(b), m))[::-1])
        return int(np.searchsorted(heavy, self.threshold * heavy[-1] - 1e-9 * heavy[-1])) + 1

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Jaccard of two bags of shingles, plain or weighted, whichever is more. A shingle
        that the item lacks weighs as much as the item's do on average unless several other
        items hold it, so an edit counts alike however often the item is repeated, and the
        result depends on the item and ``often`` alone."""
        a, n = np.unique(window, return_counts=True)
        b, m = self.bags[item]
        w = 1 / self.holders(b)
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        x = np.where(a[at] == b, n[at], 0)
        both, extra = np.minimum(x, m), b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a
        plain = both.sum() / (np.maximum(x, m).sum() + n[extra].sum())
        holders = self.holders(a[extra])
        light = np.where(holders > 1, 1 / np.maximum(holders, 1), (m * w).sum() / m.sum())
        weighted = (both * w).sum() / ((np.maximum(x, m) * w).sum() + (n[extra] * light).sum())
        return float(max(plain, weighted))

    def match(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, distance, start, words): each item's best window in each row.

        Only windows that share a shingle with an item of their length are printed: any
        other has similarity 0.
        """
        for k in sorted({min(self.shingle, int(m)) for m in self.length}):
            s = runs(h, k)
            maybe = np.flatnonzero(self.sieve[s & np.uint64((1 << 20) - 1)])
            place, found = self.find(s[maybe])
            hits, place = maybe[found], place[found]
            rows = np.searchsorted(at, hits, "right") - 1
            held = self.first[place + 1] - self.first[place]
            inside = (hits + k <= at[rows + 1]) & (held > 0)
            hits, place, rows, held = hits[inside], place[inside], rows[inside], held[inside]
            if not len(hits):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(hits)]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                ends = np.cumsum(held[a:z])
                where = np.repeat(hits[a:z], held[a:z])
                item = self.holder[np.arange(ends[-1]) - np.repeat(ends - held[a:z], held[a:z]) + np.repeat(self.first[place[a:z]], held[a:z])]
                fits = np.minimum(self.length[item], self.shingle) == k
                where, item = where[fits], item[fits]
                for m in np.unique(self.length[item]).tolist():
                    mine = np.unique(where[self.length[item] == m])
                    yield from self._row(s, mine, int(at[rows[a]]), int(at[rows[a] + 1]), int(rows[a]), m, k)

    def _row(self, s: np.ndarray, where: np.ndarray, first: int, end: int, row: int, m: int, k: int) -> Iterator[tuple]:
        """The items of ``m`` words in one row, some of which have its shingles at ``where``."""
        length = min(m, end - first)  # a shorter text is one window
        size = length - k + 1
        own = self.of_length[m]
        able = self.fewest[own] <= size if length < m else np.ones(len(own), bool)
        if not able.any():
            return
        best: dict[int, tuple[float, int, int]] = {}
        for part in np.split(where, np.flatnonzero(np.diff(where) >= 2 * m) + 1):
            lo, hi = max(first, int(part[0]) - size + 1), min(end - length, int(part[-1]))
            for a in range(lo, hi + 1, 1024):
                z = min(hi, a + 1023)
                region = s[a : z + size]
                n = self.holders(region)
                different = len(np.unique(n[n > 0])) > 1
                for x, prints in enumerate(self.prints):
                    if x and not different:
                        continue
                    got = fingerprints(region, size, n if x else None)
                    for b in range(0, len(own), 4096):
                        w, i = np.nonzero(self.candidates(got, m, x, b, min(b + 4096, len(own))) & able[b : b + 4096])
                        i += b
                        distance = np.bitwise_count(got[w] ^ prints[own[i]])
                        near = distance <= self.radius
                        for w_, i_, d in zip(w[near].tolist(), own[i[near]].tolist(), distance[near].tolist(), strict=True):
                            known = best.get(i_, (0.0, 65, 0))
                            if x and known[2] == a + w_ - first and known[0] > 0:
                                best[i_] = (known[0], min(d, known[1]), known[2])
                                continue
                            sim = self.similarity(region[w_ : w_ + size], i_)
                            if sim >= self.threshold and (sim > known[0] or (sim == known[0] and a + w_ - first < known[2])):
                                best[i_] = (sim, d, a + w_ - first)
        for i_, (sim, d, start) in best.items():
            yield row, self.ids[i_], sim, d, start, length

    def candidates(self, windows: np.ndarray, m: int, x: int, lo: int, hi: int) -> np.ndarray:
        """(window, item): the items ``lo`` (a multiple of 8) to ``hi`` of m words that stand in
        the buckets which the windows read."""
        buckets = self.buckets[m][x][:, :, lo // 8 : -(-hi // 8)]
        out = np.zeros((len(windows), buckets.shape[2]), np.uint8)
        for b, values in enumerate(windows.view(np.uint8).reshape(-1, BLOCKS).T):
            out |= buckets[b, values]
        return np.unpackbits(out, axis=1, count=hi - lo).astype(bool)


def _item_shingles(shingle: int):
    """(text, s): the shingles of each item, with a hash of its words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(0))
            h, at, _, _ = words(data, off, lower=True)
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b > a:
                    s = np.unique(runs(h[a:b], min(shingle, int(b - a))))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.repeat(runs(h[a:b], int(b - a)), len(s)), s)], ["text", "s"])

    return go


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8, radius: int = 23, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, item_id, similarity, distance, word_start, n_words): one row for each document and
    benchmark item whose best item-sized window reaches ``threshold``, in plain Jaccard
    similarity of shingles or with each weighed 1 over the number of different items of the
    whole benchmark that hold it; ``similarity`` is the greater. A document shorter than the
    item is one window.

    Words are lower-cased (A-Z) and split at ASCII white space. Documents are read once for
    each block of items of at most ``block_bytes`` / 2 of text (one item at least), which is
    broadcast at some six times that size with the shingles that several items of the whole
    benchmark hold. Windows whose fingerprint lies within ``radius`` of the item's are
    compared; two windows just at 0.8 lie farther apart with a chance below 0.0001. Items
    shorter than a shingle match as a whole; empty or null texts match nothing; of equally
    similar windows the first counts; null ids pass through; rows that repeat a document give
    repeated rows; repeated items match each under their own id, items of null id under none;
    other columns play no part; empty tables give no rows.
    """
    arrow_rows(docs.sparkSession)
    sized = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("octet_length(text) > 0").distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_bytes // 2)))
    kind = docs.schema[id_col].dataType.simpleString()
    name = docs.schema[id_col].name
    out = None
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    shared = sized.select("text").mapInArrow(_item_shingles(shingle), "text long, s long").groupBy("s").agg(F.count_distinct("text").alias("n")).where("n > 1").toArrow()
    often = shared["s"].to_numpy().view(np.uint64), shared["n"].to_numpy()
    for b in range(blocks):
        items = [tuple(r) for r in dealt.where(F.col("block") == b).select("item_id", "text").orderBy("item_id", "text").collect()]
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, often, shingle, radius, threshold))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in finishing(batches):
                data, off = buffers(batch.column(1))
                found: list[tuple] = []
                for i, j in row_groups(off):
                    h, at, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                    found += [(r[0] + i, *r[1:]) for r in index.value.match(h, at)]
                if found:
                    row, item, sim, d, start, m = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(d, pa.int32()), pa.array(start, pa.int64()), pa.array(m, pa.int32())], ["id", "item_id", "similarity", "distance", "word_start", "n_words"])

        part = docs.select(id_col, text_col).mapInArrow(scan, SCHEMA.format(id="id", kind=kind))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", name)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found. That depends on the
    text alone, so rows of null id, and rows that share an id, are judged each by its own."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    bad = find_contamination(keyed, benchmark, id_col=key, text_col=text_col, **options).select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
