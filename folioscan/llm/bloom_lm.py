"""Language-model scores from a log-frequency Bloom filter.

An n-gram of count c is entered once for each of its levels 1 .. floor(log2 c) + 1, so
repeated membership probes give its count up to a factor. The filters are built in shards
and broadcast. Beside the model, the exact add-0.1 unigram score is found by sending each
batch's distinct words to the shards that hold their counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import buffers, finishing, mix, row_groups, words
from .kneser_ney import Shard
from .workspace import arrow_rows, materialize

HASHES = 5
BITS = 7.2
END = np.uint64(0x9C0FFEE123456789)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(64 * HASHES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(64, HASHES)
HOT_SHARE = 1 << 15
ALPHA = 0.1


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """Levels of counts of at least ``least`` (a power of two)."""
    return np.floor(np.log2(counts)).astype(np.int64) - int(np.log2(least)) + 1


def level_count(level: np.ndarray, least: int) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0. Level 1 from 1 holds just 1."""
    low = float(least) * 2.0 ** (level - 1)
    return np.where(level > 0, np.where(low <= 1, 1.0, 1.5 * low - 0.5), 0.0)


def segment(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[bytes, int]:
    """The bits of one shard's filter and their number."""
    deep = levels(counts, least) if len(keys) else np.zeros(0, np.int64)
    m = max(64, int(np.ceil(deep.sum() * BITS / 64)) * 64)
    bits = np.zeros(m, np.uint8)
    for level in range(1, int(deep.max(initial=0)) + 1):
        at = keys[deep >= level]
        for k in range(HASHES):
            bits[mix(at ^ _SEEDS[level - 1, k]) % np.uint64(m)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), m


class LogBloom:
    """Shards' filters side by side; shards it does not hold are said to be absent."""

    def __init__(self, parts: dict[int, tuple[bytes, int]], shards: int, least: int):
        self.shards, self.least = shards, least
        self.size, self.first = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        at, data = 0, []
        for s, (bits, m) in sorted(parts.items()):
            self.size[s], self.first[s] = m, at
            at += m
            data.append(bits)
        self.bits = np.frombuffer(b"".join(data), np.uint8)

    def key(self, keys: np.ndarray) -> np.ndarray:
        return keys

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts, by probing level after level until one is absent."""
        level = np.zeros(len(keys), np.int64)
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        left = np.flatnonzero(self.size[shard] > 0)
        own = self.key(keys[left])
        size, first = self.size[shard[left]].astype(np.uint64), self.first[shard[left]]
        for step in range(64):
            for k in range(HASHES):
                bit = (mix(own ^ _SEEDS[step, k]) % size).astype(np.int64) + first
                hit = np.flatnonzero((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if len(hit) < len(own):
                    left, own, size, first = left[hit], own[hit], size[hit], first[hit]
                if not len(own):
                    return level_count(level, self.least)
            level[left] += 1
        return level_count(level, self.least)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before, row): words lower-cased in A-Z, then one end for each row."""
    h, at, _, _ = words(data, off, lower=True)
    n = np.diff(at)
    w = np.full(len(h) + len(n), END, np.uint64)
    is_word = np.ones(len(w), bool)
    last = np.cumsum(n + 1) - 1
    is_word[last] = False
    w[is_word] = h
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[last - n] = END
    return w, v, np.repeat(np.arange(len(n)), n + 1)


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _ODD + w)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of keys."""
    of = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s + 1] > cuts[s]:
            yield s, order[cuts[s] : cuts[s + 1]]


def _batch_tokens(data: np.ndarray, off: np.ndarray, use: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j in row_groups(off):
        if use[i:j].any():
            w, v, rows = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            keep = use[i:j][rows]
            yield i, w[keep], v[keep], rows[keep]


def count_words(docs: DataFrame) -> DataFrame:
    """(k, n): exact counts of the tokens of training rows; ``docs`` has (text, train)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            data, off = buffers(b.column("text"))
            parts = [w for _, w, _, _ in _batch_tokens(data, off, b.column("train").to_numpy(zero_copy_only=False))]
            if parts:
                k, n = _counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

    return docs.select("text", "train").mapInArrow(go, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def word_filter(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, bits, m): the filter of all words, a row for each shard."""
    schema = "shard int, bits binary, m long"

    def build(t: pa.Table) -> pa.Table:
        keys, n = t.column("k").to_numpy().view(np.uint64), t.column("n").to_numpy()
        bits, m = segment(keys, n, 1)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "bits": [bits], "m": pa.array([m])})

    of = _shard_of("k", shards)
    return counts.select(of.alias("shard"), "k", "n").groupBy("shard").applyInArrow(build, schema)


def _shard_of(column: str, shards: int):
    """column mod shards with the column read as unsigned."""
    return ((F.pmod(F.col(column), F.lit(shards)) + F.when(F.col(column) < 0, (1 << 64) % shards).otherwise(0)) % shards).cast("int")


def bigram_filter(docs: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, bits, m): the filter of bigrams seen at least ``least`` times in training rows.

    A batch's bigrams are counted in the task and sent as 32-bit prints within their shard;
    two bigrams of a shard share a print with chance 2**-32, far below the filter's own error.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            data, off = buffers(b.column("text"))
            parts = [bigram(v, w) for _, w, v, _ in _batch_tokens(data, off, b.column("train").to_numpy(zero_copy_only=False))]
            if not parts:
                continue
            k, n = _counted(np.concatenate(parts))
            out = [(s, _print(k[at], shards).tobytes(), n[at].astype(np.uint32).tobytes()) for s, at in _dealt(k, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "k", "n"])

    def build(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t.column("k").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(t.column("n").to_pylist()), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
        bits, m = segment(keys[n >= least].astype(np.uint64), n[n >= least], least)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "bits": [bits], "m": pa.array([m])})

    return docs.select("text", "train").mapInArrow(go, "shard int, k binary, n binary").groupBy("shard").applyInArrow(build, "shard int, bits binary, m long")


def _print(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys // np.uint64(shards)).astype(np.uint32)


class BigramBloom(LogBloom):
    """A filter keyed by the prints that ``bigram_filter`` sends."""

    def key(self, keys: np.ndarray) -> np.ndarray:
        return _print(keys, self.shards).astype(np.uint64)


_MAP = "shard int, batch long, head boolean, ids binary, x binary, y binary, z binary"
_BACK = "batch long, head boolean, ids binary, x binary, y binary, z binary"


def _batch_id(ordinal: int) -> int:
    """Names a batch of a deterministic scan, whichever attempt of the task reads it."""
    return TaskContext.get().partitionId() << 32 | ordinal


def _checksum(data: np.ndarray, off: np.ndarray) -> bytes:
    return struct.pack("<I", zlib.crc32(np.ascontiguousarray(off), zlib.crc32(np.ascontiguousarray(data))))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 10, least: int = 2, weight: float = 0.4, segment_bytes: int = 48 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Rows whose crc32 of the id as text leaves no remainder by ``held_out_mod`` are held out;
    all others train. ``base_score`` is the exact add-0.1 unigram log10 probability;
    ``score`` is that of a bigram model mixed with the unigram one by ``weight``, both read
    off the filters, words of any count and bigrams of at least ``least``. Filters are
    broadcast in rounds of at most ``segment_bytes`` of bigram shards, each round scoring
    the tokens whose bigram it holds; the scores add up. Words beyond 1 / 32768 of all
    tokens, which are fewer than 32768, are scored where they stand; the others go, once for
    each batch, to the shards of their counts, so no task meets all texts of a frequent word.
    The plan of ``docs`` must be deterministic, as a table scan is; batches that differ between
    rounds end the job with an error. Columns besides id and text play no part. Null texts are empty and
    score their end token; a null id counts as the text ''; repeated rows each count; an
    empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark, 10_000)  # a batch sends its distinct words once
    shards = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (crc % held_out_mod != 0).alias("train"))
    counts = materialize(count_words(rows), "words")
    total, kinds, smooth = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("n") == 1, 1.0).otherwise(1.5 * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")) + 1e-12)) - 0.5)), F.lit(0.0))).first()
    hot = np.array(counts.where(F.col("n") * HOT_SHARE > total).select("k", "n").collect(), np.int64).reshape(-1, 2)  # under HOT_SHARE rows
    uni_parts = {r[0]: (bytes(r[1]), r[2]) for r in word_filter(counts, shards).collect()}
    bi = materialize(bigram_filter(rows, shards, least), "bigrams")
    sizes = {r[0]: r[1] // 8 for r in bi.select("shard", "m").collect()}
    rounds: list[list[int]] = [[]]
    for s in range(shards):
        if rounds[-1] and sum(sizes.get(x, 0) for x in rounds[-1]) + sizes.get(s, 0) > segment_bytes:
            rounds.append([])
        rounds[-1].append(s)
    uni = spark.sparkContext.broadcast(LogBloom(uni_parts, shards, 1))
    hot_words = spark.sparkContext.broadcast((hot[:, 0].view(np.uint64), hot[:, 1].astype(np.float32)))
    base_norm = np.log10(total + ALPHA * (kinds + 1))
    smooth_norm = smooth + ALPHA * (kinds + 1)

    def model(w: np.ndarray, v: np.ndarray, grams: BigramBloom, inside: set[int]) -> np.ndarray:
        """log10 probability of tokens whose bigram falls into the round, 0 for others."""
        key = bigram(v, w)
        mine = np.flatnonzero(np.isin((key % np.uint64(shards)).astype(np.int64), np.fromiter(inside, np.int64)))
        out = np.zeros(len(w))
        if not len(mine):
            return out
        both = grams.count(key[mine])
        known, inverse = np.unique(np.concatenate([w[mine], v[mine]]), return_inverse=True)
        single = uni.value.count(known)[inverse]
        p1 = (single[: len(mine)] + ALPHA) / smooth_norm
        p2 = np.minimum(1.0, both / np.maximum(single[len(mine) :], 1.0))
        out[mine] = np.log10(weight * p2 + (1 - weight) * p1)
        return out

    def scan(grams, inside: set[int], first: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = None
            for ordinal, b in enumerate(finishing(batches)):
                if not b.num_rows:
                    continue
                if table is None:
                    table = Shard(*hot_words.value)
                data, off = buffers(b.column("text"))
                n_rows = b.num_rows
                n, known, base, lm = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.zeros(n_rows), np.zeros(n_rows)
                tail: list[np.ndarray] = []
                tail_rows: list[np.ndarray] = []
                for i, j in row_groups(off):
                    w, v, r = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    lm[i:j] += np.bincount(r, model(w, v, grams.value, inside), minlength=j - i)
                    if first:
                        n[i:j] = np.bincount(r, minlength=j - i)
                        c, seen = table.get(w)
                        base[i:j] = np.bincount(r[seen], np.log10(c[seen].astype(np.float64) + ALPHA), minlength=j - i)
                        known[i:j] = np.bincount(r[seen], minlength=j - i)
                        tail.append(w[~seen])
                        tail_rows.append((r[~seen] + i).astype(np.uint32))
                at = _batch_id(ordinal)
                out: list[tuple] = []
                if first:
                    ids = pa.BufferOutputStream()
                    with pa.ipc.new_stream(ids, pa.schema([("id", b.column("id").type), ("train", pa.bool_())])) as stream:
                        stream.write_batch(pa.RecordBatch.from_arrays([b.column("id"), b.column("train")], ["id", "train"]))
                    out.append((at % shards, at, True, ids.getvalue().to_pybytes(), n.tobytes() + _checksum(data, off), known.tobytes(), base.tobytes() + lm.tobytes()))
                    w, r = np.concatenate(tail), np.concatenate(tail_rows)
                    for s, p in _dealt(w, shards):
                        order = p[np.argsort(w[p], kind="stable")]
                        k, starts, times = np.unique(w[order], return_index=True, return_counts=True)
                        out.append((s, at, False, None, k.tobytes(), times.astype(np.uint32).tobytes(), r[order].tobytes()))
                else:
                    out.append((at % shards, at, False, None, None, _checksum(data, off), lm.tobytes()))
                for a in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[a : a + 64]], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4))], [f.split(" ")[0] for f in _MAP.split(", ")])

        return go

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Adds up what a shard's words give each row of each batch; heads pass through."""
        keys = right.column("k").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], right.column("n").to_numpy()[order].astype(np.float64)
        out: list[tuple] = []
        for batch, head, ids, x, y, z in zip(*(left.column(c).to_pylist() for c in ("batch", "head", "ids", "x", "y", "z")), strict=True):
            if head or x is None:
                out.append((batch, head, ids, x, y, z))
                continue
            k, times, r = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32), np.frombuffer(z, np.uint32)
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            c = np.where(keys[at] == k, n[at], 0.0) if len(keys) else np.zeros(len(k))
            each = np.repeat(c, times)
            some, inverse = np.unique(r, return_inverse=True)
            out.append((batch, False, None, some.tobytes(), np.bincount(inverse, each > 0).astype(np.int64).tobytes(), np.bincount(inverse, np.log10(each + ALPHA)).tobytes()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), *[pa.binary()] * 4))], names=[f.split(" ")[0] for f in _BACK.split(", ")])

    kind = docs.schema[id_col].dataType.simpleString()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        parts = t.to_pylist()
        head = next((p for p in parts if p["head"]), None)
        if head is None:
            raise RuntimeError("the scan of the documents changed between rounds")
        rows_ = pa.ipc.open_stream(head["ids"]).read_all()
        n, known = np.frombuffer(head["x"][:-4], np.int64), np.frombuffer(head["y"], np.int64).copy()
        base, lm = np.frombuffer(head["z"], np.float64).reshape(2, -1).copy()
        for p in parts:
            if p["head"]:
                continue
            if p["x"] is None:
                if p["y"] != head["x"][-4:]:
                    raise RuntimeError("the scan of the documents changed between rounds")
                lm += np.frombuffer(p["z"], np.float64)
            else:
                r = np.frombuffer(p["x"], np.uint32)
                known[r] += np.frombuffer(p["y"], np.int64)
                base[r] += np.frombuffer(p["z"], np.float64)
        train = rows_.column("train").to_numpy()
        return pa.table({"id": rows_.column("id"), "held_out": pa.array(~train), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total), "base_score": base - n * base_norm, "score": lm})

    sent = None
    for k, part in enumerate(rounds):
        chosen = {r[0]: (bytes(r[1]), r[2]) for r in bi.where(F.col("shard").isin(part)).collect()}  # at most segment_bytes
        grams = spark.sparkContext.broadcast(BigramBloom(chosen, shards, least))
        one = rows.mapInArrow(scan(grams, set(part), k == 0), _MAP)
        # batches are named by partition, so later rounds are jobs of their own
        sent = one if sent is None else sent.unionByName(materialize(one, "round"))
    by_shard = counts.where(F.col("n") * HOT_SHARE <= total).select(_shard_of("k", shards).alias("shard"), "k", "n")
    back = sent.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(answer, _BACK)
    merged = back.groupBy("batch").applyInArrow(merge, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return merged.withColumnRenamed("id", docs.schema[id_col].name)
