"""Similarity join on word shingles by chosen paths.

Documents with equal shingle sets are one node. A node's set is embedded as ``LANES`` min-hash
tokens. A run starts with all nodes in one bucket and splits it: a node goes to the child
bucket of each token that the run's hash function samples, so two nodes meet again where they
share a sampled token. Buckets of one node are dropped, small ones are searched by brute
force, large ones are split again. Runs repeat until two sets at the threshold meet with at
least the target probability. What meets and looks similar is then checked on the exact sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .kernels import buffers, finishing, mix, row_groups, shingles, words
from .workspace import arrow_rows, discard, fresh, materialize

LANES = 64
SAMPLED = 2.0
DEPTH = 3
SMALL = 64
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
_LANE_KEYS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LANE_ODD = _LANE_KEYS | np.uint64(1)


def lanes_needed(threshold: float, miss: float) -> int:
    """The most lanes that may be asked for so that two sets at ``threshold`` agree in fewer
    with probability of at most ``miss``."""
    below, k = 0.0, 0
    while True:
        below += math.comb(LANES, k) * threshold**k * (1 - threshold) ** (LANES - k)
        if below > miss or k == LANES:
            return max(1, k)
        k += 1


def miss_chance(threshold: float, runs: int, least: int, depth: int = DEPTH) -> float:
    """The chance that two sets at ``threshold`` never meet in ``runs`` runs or agree in fewer
    than ``least`` lanes.

    The lanes in which they agree are binomial. Over one level a shared lane survives with
    chance SAMPLED / LANES, so the paths of a pair with k shared lanes die out as a branching
    process of mean SAMPLED * k / LANES.
    """
    missed = 0.0
    for k in range(LANES + 1):
        dead = 0.0
        for _ in range(depth):
            dead = (1 - SAMPLED / LANES * (1 - dead)) ** k
        missed += math.comb(LANES, k) * threshold**k * (1 - threshold) ** (LANES - k) * (dead**runs if k >= least else 1.0)
    return missed


def runs_needed(threshold: float, target: float, depth: int = DEPTH) -> tuple[int, int]:
    """(runs, least shared lanes) after which two sets at ``threshold`` have met and look
    similar with probability ``target``."""
    least = lanes_needed(threshold, (1 - target) / 50)
    runs = 1
    while miss_chance(threshold, runs, least, depth) > 1 - target:
        runs += 1
    return runs, least


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each row."""
    h, at, _, _ = words(data, off)
    s, rows = shingles(h, at, size)
    cuts = np.searchsorted(rows, np.arange(len(off)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.unique(s[a:b])


def node_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        for k in range(LANES):
            out[k] = min(out[k], ((part ^ _LANE_KEYS[k]) * _LANE_ODD[k]).min())
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, node, size, sig); node and sig are null for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            data, off = buffers(b.column(1))
            keys, sizes, sigs = [], [], []
            for i, j in row_groups(off):
                for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size):
                    sizes.append(len(s))
                    keys.append(node_key(s) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["id", "node", "size", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(sign, f"id {kind}, node binary, size int, sig binary")


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return buffers(column)[0].view(kind).reshape(-1, width)


def _children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for all lanes that the paths' hash functions sample."""
    tokens = mix(sigs.astype(np.uint64) + _LANE_KEYS[None, :])
    h = mix(paths.astype(np.uint64)[:, None] ^ tokens)
    rows, lanes = np.nonzero(h < np.uint64(int(SAMPLED / LANES * 2**64)))
    return rows, mix(h[rows, lanes] + np.uint64(1))


def _split(rows: DataFrame, runs: int) -> DataFrame:
    """Child buckets (path, node) of (path, node, sig) rows, or of all runs' roots if rows have no path."""
    rooted = "path" in rows.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for b in finishing(batches):
            if not b.num_rows:
                continue
            sigs = _matrix(b.column("sig"), np.uint32, LANES)
            for root in [None] if rooted else roots:
                paths = b.column("path").to_numpy().view(np.uint64) if rooted else np.full(len(sigs), root, np.uint64)
                for a in range(0, len(sigs), 4096):
                    at, child = _children(paths[a : a + 4096], sigs[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("node").take(pa.array(at + a))], ["path", "node"])

    return rows.mapInArrow(go, "path long, node binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], act: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``act`` with the rows of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in finishing(batches):
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = np.concatenate([[0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(cols[:, a])
            if last is not None and key != last:
                yield from act(pa.Table.from_batches(held))
                held = []
            last = key
            held.append(b.slice(a, z - a))
    if held:
        yield from act(pa.Table.from_batches(held))


def _new_pairs(t: pa.Table) -> np.ndarray:
    """Which pairs of a bucket have not met in a bucket of lesser path; with blocks, only pairs
    across the two blocks (or inside the one), so that each pair counts once."""
    n = t.num_rows
    path = t.column("path")[0].as_py()
    lists = pa.concat_arrays(t.column("paths").chunks)
    off = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[off[0] : off[-1]]
    rows = np.repeat(np.arange(n), np.diff(off))
    less = values < path
    values, rows = values[less], rows[less]
    kinds, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    met = np.zeros((n, n), bool)
    if shared.any():
        met = _overlap(rows[shared], values[shared], n) > 0
    block = t.column("block").to_numpy()
    if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
        met |= block[:, None] == block[None, :]
    met |= np.tri(n, dtype=bool)
    return ~met


def _overlap(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of ``n`` rows share; 1024 values at a time, so memory is n x (n + 1024)."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    values = values[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    shared = ~new
    shared[:-1] |= ~new[1:]  # values that one row alone has count for nothing
    rows, new = rows[order[shared]], new[shared]
    column = np.cumsum(new) - 1
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        lo, hi = np.searchsorted(column, [a, a + 1024])
        m = np.zeros((n, 1024), np.float32)
        m[rows[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _agreement(sigs: np.ndarray) -> np.ndarray:
    if len(sigs) <= 48:
        return (sigs[:, None, :] == sigs[None, :, :]).sum(axis=2)
    out = np.zeros((len(sigs), len(sigs)), np.uint8)
    for lane in sigs.T:
        out += lane[:, None] == lane[None, :]
    return out


def _looks_similar(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["path", "bi", "bj", "block", "node", "paths"]

    def act(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows > 1:
            close = _agreement(_matrix(t.column("sig"), np.uint32, LANES)) >= least
            if np.count_nonzero(close) > t.num_rows:
                close &= _new_pairs(t)
                rows = np.flatnonzero(close.any(axis=0) | close.any(axis=1))
                if len(rows):
                    yield from t.select(names).take(pa.array(rows)).combine_chunks().to_batches()

    yield from _joined(_groups(batches, names[:3], act))


def _joined(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most or len(held) >= 2000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def exact_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard similarity of at least ``threshold``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n <= 4:
        inter = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        inter = _overlap(np.repeat(np.arange(n, dtype=np.int32), sizes), np.concatenate(sets), n)
    return inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, least): documents linked in this bucket, and the least node it reaches there."""

    def act(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        raw = t.column("shingles").combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        linked = exact_links(sets, threshold) & _new_pairs(t)
        linked |= linked.T
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            return
        links = linked[rows] @ t.column("n").to_numpy()
        nodes = t.column("node").to_pylist()
        rank = np.empty(len(nodes), np.int64)
        rank[sorted(range(len(nodes)), key=nodes.__getitem__)] = np.arange(len(nodes))
        by_rank = {int(r): nodes[i] for i, r in enumerate(rank)}
        least = rank.copy()
        while True:
            now = np.minimum(least, np.where(linked, least[None, :], len(nodes)).min(axis=1))
            if (now == least).all():
                break
            least = now
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in rows], pa.binary()), pa.array(links.astype(np.int64)), pa.array([by_rank[int(least[i])] for i in rows], pa.binary())], ["node", "links", "least"])

    yield from _joined(_groups(batches, ["path", "bi", "bj"], act))


def _chosen_buckets(reps: DataFrame, runs: int, depth: int, small: int) -> DataFrame:
    """(path, node, count, mass): the final buckets of two nodes or more."""
    frontier = materialize(_split(reps.select("node", "sig"), runs), "paths")
    frontiers = [frontier]
    done: DataFrame | None = None
    for level in range(1, depth + 1):
        sizes = frontier.groupBy("path").agg(F.count("*").alias("count")).where("count > 1")
        kept = frontier.join(sizes, "path")
        final = kept if level == depth else kept.where(F.col("count") <= small)
        done = final.select("path", "node") if done is None else done.unionByName(final.select("path", "node"))
        if level == depth:
            break
        large = kept.where(F.col("count") > small).select("path", "node")
        frontier = materialize(_split(large.join(reps.select("node", "sig"), "node"), runs), "paths")
        frontiers.append(frontier)
        if frontier.limit(1).count() == 0:
            break
    out = materialize(done, "buckets")
    for f in frontiers:
        discard(f)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, target_recall: float = 0.999, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """(id, class_id, n_links) for each row of ``docs``.

    ``n_links`` counts the other rows whose shingle sets have Jaccard similarity of at least
    ``threshold``; ``class_id`` is the least id of the connected component of such links. A
    pair just at the threshold is found with probability ``target_recall``: that covers the
    runs and the least number of min-hash lanes asked for before the exact check; more
    similar pairs are missed less often, equal sets never.
    Words are split at ASCII white space; a text of fewer than ``shingle`` words has one
    shingle of them all. Texts without words (empty, null) link to nothing, and each is its
    own class; rows of null id stay, and count as links; rows that repeat a document link to
    each other; an empty table gives no rows; columns of ``docs`` besides id and text play no
    part, whatever their names. Buckets above ``BLOCK_ROWS`` rows or ``BLOCK_SHINGLES``
    shingles are searched in pairs of blocks, so none is cut short, and a pair counts in the
    least bucket where it meets. Pairs are counted in tasks and never become rows.
    """
    arrow_rows(docs.sparkSession)
    signed = materialize(_signed(docs, id_col, text_col, shingle), "signed")
    reps = materialize(signed.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig")), "nodes")
    runs, least = runs_needed(threshold, target_recall, depth)
    buckets = _chosen_buckets(reps, runs, depth, small)
    lists = buckets.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    info = reps.join(lists, "node").select("node", "sig", "size", "paths")
    rows = buckets.join(info, "node")
    weight = rows.groupBy("path").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(weight) if weight.limit(10_001).count() <= 10_000 else weight, "path", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("bi"), F.greatest(k, F.col("block")).alias("bj")))
    dealt = rows.withColumn("block", own).withColumn("pair", F.explode(pairs)).select("path", "pair.bi", "pair.bj", "block", "node", "paths", "sig")
    key = ["path", "bi", "bj"]
    alike = materialize(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda b: _looks_similar(b, least), "path long, bi int, bj int, block int, node binary, paths array<long>"), "alike")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            data, off = buffers(b.column(0))
            for i, j in row_groups(off):
                sets = list(shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle))
                yield pa.RecordBatch.from_arrays([pa.array([node_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    wanted = alike.select("node").distinct().join(reps.select("node", "rep", "n"), "node")
    every = docs.select(F.col(id_col).alias("_rep"), F.col(text_col).alias("_text"))
    texts = every.join(wanted.select(F.col("rep").alias("_rep")).distinct(), "_rep", "left_semi")
    if reps.where("rep is null").limit(1).count():  # texts that only rows of null id hold
        texts = texts.unionByName(every.where("_rep is null"))
    sets = texts.select("_text").mapInArrow(expand, "node binary, shingles binary").dropDuplicates(["node"]).join(wanted.select("node", "n"), "node")
    checked = alike.join(sets, "node").repartition(*key).sortWithinPartitions(*key)
    found = materialize(checked.mapInArrow(lambda b: _links(b, threshold), "node binary, links long, least binary"), "links")
    discard(buckets), discard(alike)
    parts = connected_components(found.select(F.col("node").alias("src"), F.col("least").alias("dst")))
    classes = parts.join(reps.select(F.col("node"), "rep"), "node")
    classes = classes.join(classes.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("node", "class_id")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = reps.select("node", "n", "rep").join(classes, "node", "left").join(linked, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    out = signed.select("id", "node").join(by_node, "node", "left").select(F.col("id").alias(docs.schema[id_col].name), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the least id, and of
    rows of one id that of the least digest of its text; a null id comes after all others.
    Rows are told apart by id and text together, so rows that share an id, or have none, are
    judged each by its own text; of rows equal in both one stays. Texts without words link
    to nothing."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("c")))
    found = materialize(near_duplicates(keyed, id_col=key, text_col=text_col, **options).select(F.col(key).alias("_key"), F.col("class_id").alias("_class")), "classes")
    gone = found.where("_key != _class").select("_key").distinct()
    out = keyed.join(gone.withColumnRenamed("_key", key), key, "left_anti")
    if found.groupBy("_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([key])
    return out.select(*docs.columns)
