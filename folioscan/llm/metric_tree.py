"""Exact top-k inner products by best-first search over pages of a metric tree.

Vectors of components floor(1024 x) get one more coordinate that gives all the same norm;
then the largest inner product is the nearest point: |q - x|^2 = |q|^2 + M - 2 q.x, with M
the largest squared norm. Inner nodes are pivots, whose number grows with the table; each
has the radius that covers its vectors. Leaf pages hold vectors near one pivot that lie in a
ring of distances from it, each with its distance to that parent. A node's radius bounds
every distance below it, a page's ring every distance inside it, and a vector's parent
distance its own, all by the triangle inequality, before anything is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import finishing
from .workspace import materialize

SCALE = 1024
PAGE_ROWS = 256
PIVOTS = 64
ROWS_PER_PIVOT, MOST_PIVOTS = 4096, 4096
QUERY_BLOCK = 1024
RUN_BYTES = 32 << 20
EXACT = 2.0**53
MOST_LONG, LEAST_LONG = 2**63 - 1, -(2**63)


def integers(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """(positions, vectors of whole numbers, as doubles) of the rows whose vector is whole and
    finite, before and after scaling."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    values = column.values
    holes = np.asarray(values.is_null())
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    good = np.isfinite(x) & ~holes
    valid = np.asarray(column.is_valid())
    rows, out = [], []
    for r in range(len(column)):
        a, b = off[r], off[r + 1]
        if valid[r] and good[a:b].all():
            rows.append(r)
            out.append(x[a:b])
    return rows, out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers: through doubles where no sum can
    round, through 64 bits where none can overflow, else through Python's own integers. Those
    beyond a long become the nearest long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = ([list(map(int, row)) for row in x.tolist()] for x in (a, b))
    return np.array([[min(MOST_LONG, max(LEAST_LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in right] for p in left], np.int64).reshape(len(left), len(right))


def rounding(norm: np.ndarray, most: float, dim: int) -> np.ndarray:
    """How far a computed distance to a lifted point may lie from the true one: the squared
    distance is a sum of dim + 3 products no larger than ``norm`` + ``most``, each rounded."""
    return 4 * np.sqrt((dim + 8) * 2.0**-52 * (norm + most))


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v, norm) of the rows that take part; v holds the integers as bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            rows, x = integers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([_norm(v) for v in x], pa.float64())], ["id", "dim", "v", "norm"])

    typed = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("x is not null")
    return typed.mapInArrow(go, "id long, dim int, v binary, norm double")


def _norm(v: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(v @ v)


class Pivots:
    """The tree's inner nodes: a sample of vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, most: float):
        self.v, self.most = vectors, most
        self.bounded = most < 1e300  # else squares overflow, and nothing is bounded
        self.norms = (vectors**2).sum(axis=1) if self.bounded else np.zeros(len(vectors))
        self.lift = np.sqrt(np.maximum(most - self.norms, 0)) if self.bounded else self.norms

    def to(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of points to all pivots; a query is not lifted."""
        if not self.bounded:
            return np.zeros((len(x), len(self.v)))
        n = (x**2).sum(axis=1)
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - n, 0))
        d = n[:, None] + lift[:, None] ** 2 + self.most - 2 * (x @ self.v.T + lift[:, None] * self.lift[None, :])
        return np.sqrt(np.maximum(d, 0))

    def reach(self, norms: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Within what distance a vector can still score ``floors``; NaN floors set no bound."""
        if not self.bounded:
            return np.full(len(norms), np.inf)
        d = np.sqrt(np.maximum(0, norms + self.most - 2 * floors)) + 2 * rounding(norms, self.most, self.v.shape[1])
        return np.where(np.isnan(d), np.inf, d)


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def build_pages(points: DataFrame, pivots: dict[int, Pivots], page_rows: int = PAGE_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(dim, part, pivot, near, far, ids, parents, v): leaf pages of at most ``page_rows``
    vectors. Vectors are dealt by ranges of (pivot, distance to it, id), so a hot pivot or a
    hot vector spreads over as many pages as it needs; consecutive pages of some ``run_bytes``
    make a part, which one task searches."""
    held = points.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = b.filter(pa.array(dims == dim))
                d = held.value[int(dim)].to(_stack(rows.column("v"), int(dim)), False)
                p = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("dim"), rows.column("v"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], ["id", "dim", "v", "pivot", "parent"])

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "part", "pivot", "near", "far", "ids", "parents", "v"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        task, done = TaskContext.get().partitionId(), 0
        for b in finishing(batches):
            dim, pivot, parent, ids = (b.column(c).to_numpy() for c in ("dim", "pivot", "parent", "id"))
            cut = np.concatenate([[0], np.flatnonzero((dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1])) + 1, [len(dim)]])
            out = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                for a in range(s, e, page_rows):
                    z = min(e, a + page_rows)
                    v = b"".join(b.column("v").slice(a, z - a).to_pylist())
                    out.append((int(dim[a]), task << 32 | done // run_bytes, int(pivot[a]), float(parent[a:z].min()), float(parent[a:z].max()), ids[a:z].tobytes(), parent[a:z].tobytes(), v))
                    done += len(v) + 16 * (z - a)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    placed = points.select("id", "dim", "v").mapInArrow(nearest, "id long, dim int, v binary, pivot int, parent double")
    order = ["dim", "pivot", "parent", "id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(page, "dim int, part long, pivot int, near double, far double, ids binary, parents binary, v binary")


def search_pages(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, pivots: Pivots, pages: list[tuple], k: int) -> tuple[list[tuple[int, int, int]], int]:
    """Best-first over (pivot, near, far, ids, parents, vectors) pages for each query: (query
    row, id, score) of the best found, and how many scores were computed. ``floors`` holds
    each query's k-th score found so far, or NaN."""
    norms = (queries**2).sum(axis=1) if pivots.bounded else np.zeros(len(queries))
    pivot, near, far = (np.array([p[c] for p in pages]) for c in range(3))
    own = pivots.to(queries, True)[:, pivot]
    error = rounding(norms, pivots.most, queries.shape[1]) if pivots.bounded else np.zeros(len(queries))
    low = np.maximum(np.maximum(own - far, near - own), 0)
    reach = pivots.reach(norms, floors)
    out, computed = [], 0
    for q in range(len(queries)):
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, limit = floors[q], reach[q]
        for p in np.argsort(low[q], kind="stable"):
            if low[q, p] > limit + 2 * error[q]:
                break
            _, _, _, ids, parents, vectors = pages[p]
            keep = (np.abs(own[q, p] - parents) <= limit + 2 * error[q]) & (ids != query_ids[q])
            if not keep.any():
                continue
            score = products(queries[q : q + 1], vectors[keep])[0]
            computed += len(score)
            s, i = np.concatenate([best_score, score]), np.concatenate([best_id, ids[keep]])
            order = np.lexsort((i, -s.astype(np.float64)))[:k] if len(s) and s.min() == LEAST_LONG else np.lexsort((i, -s))[:k]
            best_score, best_id = s[order], i[order]
            if len(best_score) == k and not best_score[-1] <= floor:
                floor = float(best_score[-1])
                limit = pivots.reach(norms[q : q + 1], np.array([floor]))[0]
        out += [(q, int(i), int(s)) for i, s in zip(best_id, best_score, strict=True)]
    return out, computed


_VISIT = "part long, dim int, pages boolean, pivot int, near double, far double, ids binary, parents binary, v binary, floors binary"


def _search(pages: DataFrame, visits: DataFrame, held: Broadcast, k: int) -> DataFrame:
    """(query_id, id, score, computed). ``visits`` has (part, dim, ids, v, floors), a row for
    each block of queries that visits a part; the part's pages come to its task once and the
    blocks pass by."""
    none = lambda kind: F.lit(None).cast(kind)
    left = pages.select("part", "dim", F.lit(True).alias("pages"), "pivot", "near", "far", "ids", "parents", "v", none("binary").alias("floors"))
    right = visits.select("part", "dim", F.lit(False).alias("pages"), none("int").alias("pivot"), none("double").alias("near"), none("double").alias("far"), "ids", none("binary").alias("parents"), "v", "floors")
    names = [f.split(" ")[0] for f in _VISIT.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for b in finishing(batches):
            for row in zip(*(b.column(c) for c in names), strict=True):
                part, dim, is_page, pivot, near, far, ids, parents, v, floors = (x.as_py() for x in row)
                if (part, dim) != at:
                    at, mine = (part, dim), []
                if is_page:
                    mine.append((pivot, near, far, np.frombuffer(ids, np.int64), np.frombuffer(parents, np.float64), np.frombuffer(v, np.float64).reshape(len(ids) // 8, dim)))
                elif mine:
                    own = np.frombuffer(ids, np.int64)
                    found, computed = search_pages(np.frombuffer(v, np.float64).reshape(len(own), dim), own, np.frombuffer(floors, np.float64), held.value[dim], mine, k)
                    done = np.array(found, np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(own[done[:, 0]]), pa.array(done[:, 1]), pa.array(done[:, 2]), pa.array(np.full(len(done), computed))], ["query_id", "id", "score", "computed"])

    order = [F.col("part"), F.col("dim"), F.col("pages").desc()]
    return left.unionByName(right).repartition("part").sortWithinPartitions(*order).mapInArrow(go, "query_id long, id long, score long, computed long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str | None = None, page_rows: int = PAGE_ROWS, pivots: int = PIVOTS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(query_id, id, score, computed): what the parts found for each query, k at most each;
    ``computed`` is the number of scores computed for the block of queries in the part."""
    points = materialize(_prepared(vectors, id_col, vector_col), "points")
    asked = _prepared(queries, query_id_col or id_col, vector_col).dropDuplicates(["id"])
    few = points.groupBy("dim").agg(F.max("norm").alias("most"), F.count("*").alias("n")).withColumn("pivots", F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(pivots), F.ceil(F.col("n") / ROWS_PER_PIVOT))))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = points.join(F.broadcast(few), "dim").where(h < F.ceil(F.lit(4.0 * (1 << 30)) * F.col("pivots") / F.col("n")))
    chosen = sample.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))).where("r <= pivots").select("dim", "v", "most", "r")
    by_dim: dict[int, list] = {}
    for r in chosen.orderBy("dim", "r").collect():
        by_dim.setdefault(r[0], []).append(r)
    nodes = {d: Pivots(np.stack([np.frombuffer(bytes(x[1]), np.float64) for x in rows]), float(rows[0][2])) for d, rows in by_dim.items()}
    pages = materialize(build_pages(points, nodes, page_rows, run_bytes), "pages")
    held = points.sparkSession.sparkContext.broadcast(nodes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) in held.value:
                    rows = b.filter(pa.array(dims == dim))
                    p = held.value[int(dim)].to(_stack(rows.column("v"), int(dim)), True).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("dim"), rows.column("v"), pa.array(p.astype(np.int32))], ["id", "dim", "v", "home"])

    homes = asked.mapInArrow(home, "id long, dim int, v binary, home int")
    # blocks of queries that share a home
    number = F.row_number().over(Window.partitionBy("dim", "home", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1
    homes = materialize(homes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("block", F.floor(number / (QUERY_BLOCK // 4)).cast("int")), "queries")
    block = ["dim", "home", "salt", "block"]

    def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
        """(..., ids, v, floors) of each block, as bytes."""

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            floors = np.array([np.nan if x is None else float(x) for x in t.column("floor").to_pylist()], np.float64)
            head = {c: t.column(c).slice(0, 1) for c in keys}
            return pa.table(head | {"ids": [t.column("id").to_numpy().tobytes()], "v": [b"".join(t.column("v").to_pylist())], "floors": [floors.tobytes()]})

        kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}
        return rows.select(*keys, "id", "v", "floor").groupBy(*keys).applyInArrow(pack, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", ids binary, v binary, floors binary")

    rings = materialize(pages.groupBy("dim", "part", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")), "rings")
    blocks = packed(homes.withColumn("floor", F.lit(None).cast("long")), block)
    start = blocks.join(rings.select("dim", "part", F.col("pivot").alias("home")), ["dim", "home"]).select("part", "dim", "ids", "v", "floors")
    at_home = pages.join(homes.select("dim", F.col("home").alias("pivot")).distinct(), ["dim", "pivot"], "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    first = _search(at_home, start, held, k)
    floors = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = materialize(homes.join(floors, "id", "left"), "bounds")
    radius = {(r[0], r[1]): (r[2], r[3]) for r in rings.groupBy("dim", "pivot").agg(F.min("near"), F.max("far")).collect()}  # a row for each pivot

    def let_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, home, salt, block, pivot, low, high): which parent distances may hold an answer."""
        for b in finishing(batches):
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                p, q = held.value[dim], _stack(rows.column("v"), dim)
                d = p.to(q, True)
                norms = (q**2).sum(axis=1) if p.bounded else np.zeros(len(q))
                floor = np.array([np.nan if x is None else float(x) for x in rows.column("floor").to_pylist()], np.float64)
                reach = p.reach(norms, floor) + (2 * rounding(norms, p.most, dim) if p.bounded else 0)
                near, far = np.array([radius.get((dim, x), (np.inf, -np.inf)) for x in range(d.shape[1])]).T
                keys = np.stack([rows.column(c).to_numpy() for c in block[1:]])
                _, lead, of = np.unique(keys, axis=1, return_index=True, return_inverse=True)
                for x, a in enumerate(lead.tolist()):
                    mine = of.ravel() == x
                    low, high = (d[mine] - reach[mine, None]).min(axis=0), (d[mine] + reach[mine, None]).max(axis=0)
                    open_ = np.flatnonzero((far >= low) & (near <= high))
                    n = len(open_)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), *(pa.array(np.full(n, keys[c, a], keys.dtype)) for c in range(3)), pa.array(open_.astype(np.int32)), pa.array(low[open_]), pa.array(high[open_])], [*block, "pivot", "low", "high"])

    salted = homes.schema["salt"].dataType.simpleString()
    kinds = f"dim int, home int, salt {salted}, block int, pivot int, low double, high double"
    ask = bounded.select("dim", "v", "floor", *block[1:]).mapInArrow(_typed(let_in, kinds), kinds).groupBy(*block, "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = ask.join(rings, ["dim", "pivot"]).where("far >= low and near <= high").select(*block, "part").distinct()
    visits = pairs.join(packed(bounded, block), block).select("part", "dim", "ids", "v", "floors")
    return _search(pages, visits, held, k)


def _typed(f, schema: str):
    """``f`` with its columns cast to ``schema``."""
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[x.split(" ")[1]] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(batches):
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(b.columns, kinds, strict=True)], b.schema.names)

    return go


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", **options) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products, ties to
    the lesser id, over all vectors of its dimension but its own id.

    Null vectors, vectors with null or non-finite components (also after scaling), and rows of
    null id take no part; vectors meet only vectors of their dimension; an empty table gives no
    rows; other columns play no part. Scores beyond a long are the nearest long. Rows that
    repeat an id with equal vectors count once as a query and each as a candidate. Queries are
    blocked by the pivot nearest to them; a first round searches that pivot's pages for a
    bound, the second all parts that the bound lets in. Only pivots go to the driver and to
    the workers: one for ROWS_PER_PIVOT vectors, at most MOST_PIVOTS for each dimension.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = search(vectors, queries, k, id_col=id_col, **options)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
