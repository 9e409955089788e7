"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Training counts are DataFrames hashed by n-gram; each order is joined to the next lower one
and to its contexts. Documents are scored by joins too: a document's n-grams go, packed by
batches of text, to the shard of their middle word, which holds all of the model's entries
for that word, and what each shard adds to a document's log probability is summed up again.
Only the vocabulary with its unigram probabilities and back-off weights, and a membership
filter of the pairs of words that the model has met, are broadcast; both are bounded by the
sample that the model is fitted on. A word that forms no such pair with those before it has no
n-gram to meet and is scored where it stands.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernels import buffers, finishing, mix, row_groups, words
from .workspace import arrow_rows, discard, fresh, materialize

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_C2, _C3, _K2, _K3 = (np.uint64(k * 0x1000193) for k in range(1, 5))
SHARDS = 16
SHARE, SLACK = 0.995, 1.0


def _tag(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(h ^ kind)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


def _tokens(h: np.ndarray, at: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, row): each word and each row's end with the two tokens before it; the
    language is mixed into each token, so languages share no counts."""
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n + 1)
    w = np.full(len(h) + len(n), END, np.uint64)
    is_word = np.ones(len(w), bool)
    is_word[np.cumsum(n + 1) - 1] = False
    w[is_word] = h
    first = np.cumsum(n + 1) - (n + 1)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = START
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[first] = START
    salt = langs[rows]
    return mix(u + salt), mix(v + salt), mix(w + salt), rows


def _lang_hash(column: pa.Array) -> np.ndarray:
    data, off = buffers(column)
    values = [bytes(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    known = {x: np.uint64(int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "little")) for x in set(values)}
    return np.array([known[x] for x in values], np.uint64)


def _discounts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 from counts of counts."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(value, F.lit(k - 0.5)))).alias(f"d{k}")

    return counts.groupBy(*group).agg(*n).select(*group, d(1), d(2), d(3))


def _discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts with own share ``a``, contexts with back-off weight ``g``)."""
    d = F.broadcast(_discounts(counts, ["lang"]))  # a row for each language
    with_d = counts.join(d, "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    sums = with_d.groupBy("lang", *context).agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    shares = with_d.join(sums, ["lang", *context]).withColumn("a", (F.col("c") - F.col("d")) / F.col("total"))
    return shares, sums.withColumn("g", F.col("left") / F.col("total")).select("lang", *context, "g")


def fit(trusted: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(kind, a, b, c, value): log10 probabilities of seen n-grams (kinds 1 to 3) and log10
    back-off weights of contexts (kinds 12, 13); kind 0 holds an unseen word's by language.

    A text is its words between two starts and an end. Null and empty texts count as one end;
    null languages are one; rows that repeat count each time; other columns play no part; an
    empty table gives no rows.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(0))
            langs = _lang_hash(b.column(1))
            for i, j in row_groups(off):
                h, at, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=False)
                u, v, w, rows = _tokens(h, at, langs[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (langs[i:j][rows], u, v, w)], ["lang", "u", "v", "w"])

    tri = materialize(trusted.select(text_col, lang_col).mapInArrow(grams, "lang long, u long, v long, w long").groupBy("lang", "u", "v", "w").agg(F.count("*").alias("c")), "trigrams")
    bi = materialize(tri.groupBy("lang", "v", "w").agg(F.count("*").alias("c")), "bigrams")
    uni = materialize(bi.groupBy("lang", "w").agg(F.count("*").alias("c")), "unigrams")
    s3, g3 = _discounted(tri, ["u", "v"])
    s2, g2 = _discounted(bi, ["v"])
    s1, g1 = _discounted(uni, [])
    sizes = uni.groupBy("lang").agg((F.count("*") + 1).alias("words"))
    base = g1.join(sizes, "lang").select("lang", (F.col("g") / F.col("words")).alias("unseen"))
    p1 = materialize(s1.join(F.broadcast(base), "lang").select("lang", "w", (F.col("a") + F.col("unseen")).alias("p1")), "p1")
    p2 = materialize(s2.join(g2, ["lang", "v"]).join(p1, ["lang", "w"]).select("lang", "v", "w", (F.col("a") + F.col("g") * F.col("p1")).alias("p2")), "p2")
    p3 = s3.join(g3, ["lang", "u", "v"]).join(p2, ["lang", "v", "w"]).select("u", "v", "w", (F.col("a") + F.col("g") * F.col("p2")).alias("p3"))
    none = F.lit(0).cast("long")

    def rows(kind: int, df: DataFrame, a: Column, b: Column, c: Column, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"), F.log10(value).cast("float").alias("value"))

    col = F.col
    parts = [rows(3, p3, col("u"), col("v"), col("w"), "p3"), rows(2, p2, col("v"), col("w"), none, "p2"), rows(1, p1, col("w"), none, none, "p1"), rows(13, g3, col("u"), col("v"), none, "g"), rows(12, g2, col("v"), none, none, "g"), rows(0, base, col("lang"), none, none, "unseen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Shard:
    """A probing table from 64-bit keys to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 1)
        slot = keys >> np.uint64(64 - self.bits)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max(initial=0))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, found = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < end)
        for _ in range(self.deep):
            if not len(todo):
                break
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            found[todo[hit]] = True
            at[todo] += 1
            todo = todo[~hit & (at[todo] < end[todo])]
        return out, found


def _keys(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    if kind == 3:
        return _tag(pair_key(pair_key(a, b), c), _K3)
    if kind == 2:
        return _tag(pair_key(a, b), _K2)
    if kind == 13:
        return _tag(pair_key(a, b), _C3)
    return _tag(a, _C2)


class Vocabulary:
    """The model's words with small numbers (0 for all others), log10 unigram probabilities
    and back-off weights, each language's probability of an unseen word, and the pairs met."""

    def __init__(self, words_: np.ndarray, p1: np.ndarray, g2: np.ndarray, unseen: dict[int, float], pairs: np.ndarray):
        self.hash = np.concatenate([np.zeros(1, np.uint64), words_])
        self.p1 = np.concatenate([np.full(1, np.nan, np.float32), p1])
        self.g2 = np.concatenate([np.zeros(1, np.float32), g2])
        self.unseen = unseen
        self.mask = np.uint64((1 << max(10, int(16 * len(pairs)).bit_length())) - 1)
        bits = np.zeros(int(self.mask) + 1, bool)
        for at in self._bits(pairs):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")
        self.kind = np.uint16 if len(self.hash) <= 1 << 16 else np.uint32
        self.table: Shard | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _bits(self, pairs: np.ndarray) -> list[np.ndarray]:
        return [pairs & self.mask, mix(pairs) & self.mask]

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model may hold the pair; never false where it does."""
        out = np.ones(len(a), bool)
        for at in self._bits(pair_key(a, b)):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def numbers(self, words_: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = Shard(self.hash[1:], np.arange(1, len(self.hash), dtype=np.int32))
        return self.table.get(words_)[0]


def vocabulary(model: DataFrame) -> Vocabulary:
    """From a model's unigrams, contexts and pairs: at most a word and two pairs for each token
    of the sample."""
    rows = model.where("kind in (0, 1, 12)").select("kind", "a", "value").toArrow()
    kind, a, value = rows.column("kind").to_numpy(), rows.column("a").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    every = np.unique(a[kind != 0])
    p1, g2 = np.full(len(every), np.nan, np.float32), np.zeros(len(every), np.float32)
    p1[np.searchsorted(every, a[kind == 1])] = value[kind == 1]
    g2[np.searchsorted(every, a[kind == 12])] = value[kind == 12]
    pairs = model.where("kind in (2, 13)").select("a", "b").distinct().toArrow()
    keys = pair_key(*(pairs.column(c).to_numpy().view(np.uint64) for c in "ab"))
    return Vocabulary(every, p1, g2, dict(zip(a[kind == 0].tolist(), value[kind == 0].tolist(), strict=True)), keys)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


_SENT = ["part", "shard", "batch", "tokens", "u", "v", "w", "r", "keys", "vals"]
_SENT_SCHEMA = "part int, shard int, batch long, tokens boolean, u binary, v binary, w binary, r binary, keys binary, vals binary"
_SENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]


def _shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return ((v >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)


def _packed_model(model: DataFrame, shards: int, copies: int) -> DataFrame:
    """The entries of contexts and n-grams of two words or more by shard of their middle word,
    ``copies`` times."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finishing(batches):
            kind, value = b.column("kind").to_numpy(), b.column("value").to_numpy()
            a, bb, c = (b.column(x).to_numpy().view(np.uint64) for x in "abc")
            k = np.zeros(len(kind), np.uint64)
            for one in np.unique(kind):
                at = kind == one
                k[at] = _keys(int(one), a[at], bb[at], c[at])
            shard = _shard_of(np.where(np.isin(kind, (3, 13)), bb, a), shards)
            out = []
            for x in np.unique(shard).tolist():
                keys, vals = k[shard == x].tobytes(), value[shard == x].tobytes()
                out += [(x * copies + r, x, 0, False, None, None, None, None, keys, vals) for r in range(copies)]
            if out:
                yield _table(out, _SENT, _SENT_TYPES)

    return model.where("kind in (2, 3, 12, 13)").mapInArrow(packed, _SENT_SCHEMA)


def _weigh(u: np.ndarray, v: np.ndarray, w: np.ndarray, p1: np.ndarray, table: Shard) -> np.ndarray:
    """What the entries of v's shard say of log10 P(w | u v), backing off through the orders;
    ``p1`` holds log10 unigram probabilities, or NaN where an unseen word's is added elsewhere."""
    out = np.zeros(len(w), np.float64)
    value, seen = table.get(_keys(3, u, v, w))
    out[seen] = value[seen]
    rest = np.flatnonzero(~seen)
    out[rest] += table.get(_keys(13, u[rest], v[rest], w))[0]
    value, seen = table.get(_keys(2, v[rest], w[rest], w))
    out[rest[seen]] += value[seen]
    rest = rest[~seen]
    out[rest] += table.get(_keys(12, v[rest], w, w))[0]
    out[rest] += np.nan_to_num(p1[rest], nan=0.0)
    return out


def score(docs: DataFrame, model: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """(id, lang, n_tokens, log10_prob) of every whole text; each has one end token.

    Each batch of texts sends its words' numbers to ``shards`` shards by middle word. The
    shards are dealt to as many tasks as there are shuffle partitions, by batches, each with a
    copy of its shard's entries: a word in a third of all texts is spread over all copies.
    Words that form no pair the model has met are scored where they stand.
    Null and empty texts score their end; null languages are one; languages without a model
    give each token 1e-7; null ids and repeated rows pass through; an empty table gives no
    rows. A batch whose parts do not all arrive (a scan that changes between attempts) fails.
    """
    spark = docs.sparkSession
    words_ = spark.sparkContext.broadcast(vocabulary(model))
    copies = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    kind = docs.schema[id_col].dataType
    held: StructType = StructType().add("id", kind).add("lang", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_.value
        task = TaskContext.get().partitionId()
        ordinal = 0
        for b in finishing(batches):
            data, off = buffers(b.column(1))
            langs = _lang_hash(b.column(2))
            for first, last in row_groups(off):
                for i in range(first, last, 1 << 16):
                    j = min(last, i + (1 << 16))
                    h, at, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    u, v, w, rows = _tokens(h, at, langs[i:j])
                    un, vn, wn = (known.numbers(x) for x in (u, v, w))
                    p1 = known.p1[wn]
                    lacking = np.array([known.unseen.get(x, -7.0) for x in langs[i:j].tolist()])[rows]
                    asks = vn > 0
                    asks[asks] = known.met(v[asks], w[asks]) | known.met(u[asks], v[asks])
                    local = np.where(np.isnan(p1), lacking, np.where(asks, 0.0, p1)) + np.where(asks, 0.0, known.g2[vn])
                    batch = task << 32 | ordinal
                    ordinal += 1
                    sent = np.flatnonzero(asks)
                    shard = _shard_of(v[sent], shards)
                    sent = sent[np.lexsort((wn[sent], vn[sent], shard))]
                    cuts = np.searchsorted(_shard_of(v[sent], shards), np.arange(shards + 1))
                    out = []
                    for x in range(shards):
                        part = sent[cuts[x] : cuts[x + 1]]
                        if len(part):
                            out.append((x * copies + batch % copies, x, batch, True, *(_planes(y[part].astype(known.kind)) for y in (un, vn, wn)), _planes(rows[part].astype(np.uint16)), None, None))
                    stream = pa.BufferOutputStream()
                    with pa.ipc.new_stream(stream, pa.schema([("id", b.schema.field(0).type), ("lang", pa.string())])) as head:
                        head.write_batch(pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)], ["id", "lang"]))
                    n = (np.diff(at) + 1).astype(np.int64)
                    # the head goes the way of the first shard, and passes through
                    out.append((batch % copies, 0, batch, True, None, None, None, n.tobytes() + np.bincount(rows, local, minlength=j - i).tobytes(), stream.getvalue().to_pybytes(), struct.pack("<i", len(out))))
                    yield _table(out, _SENT, _SENT_TYPES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part, the model's first: one shard's entries are held at a time."""
        known, at, parts, table = words_.value, None, [], None
        for b in finishing(batches):
            out = []
            for part, _, batch, tokens, u, v, w, r, keys, vals in zip(*(b.column(c) for c in _SENT), strict=True):
                part = part.as_py()
                if part != at:
                    at, parts, table = part, [], None
                if not tokens.as_py():
                    parts.append((keys.as_py(), vals.as_py()))
                    continue
                if not u.is_valid:
                    out.append((batch.as_py(), r.as_py(), keys.as_py(), vals.as_py()))
                    continue
                if table is None:
                    table = Shard(np.frombuffer(b"".join(p[0] for p in parts), np.uint64), np.frombuffer(b"".join(p[1] for p in parts), np.float32))
                    parts = []
                un, vn, wn = (_unplanes(x.as_py(), known.kind) for x in (u, v, w))
                got = _weigh(known.hash[un], known.hash[vn], known.hash[wn], known.p1[wn], table)
                rows, inverse = np.unique(_unplanes(r.as_py(), np.uint16), return_inverse=True)
                out.append((batch.as_py(), rows.tobytes(), np.bincount(inverse, got).tobytes(), None))
                if len(out) >= 256:
                    yield _table(out, ["batch", "x", "y", "z"], [pa.int64(), *[pa.binary()] * 3])
                    out = []
            if out:
                yield _table(out, ["batch", "x", "y", "z"], [pa.int64(), *[pa.binary()] * 3])

    def merge(t: pa.Table) -> pa.Table:
        parts = t.to_pylist()
        heads = [p for p in parts if p["z"] is not None]
        if len(heads) != 1 or struct.unpack("<i", heads[0]["z"])[0] != len(parts) - 1:
            raise RuntimeError("parts of a batch are missing: the scan of the documents changed between attempts")
        rows = pa.ipc.open_stream(heads[0]["y"]).read_all()
        n, total = np.frombuffer(heads[0]["x"], np.int64)[: len(rows)], np.frombuffer(heads[0]["x"], np.float64)[len(rows) :].copy()
        for p in sorted((p for p in parts if p["z"] is None), key=lambda p: p["y"]):
            total[np.frombuffer(p["x"], np.uint16)] += np.frombuffer(p["y"], np.float64)
        return pa.table({"id": rows.column("id"), "lang": rows.column("lang"), "n_tokens": n, "log10_prob": total})

    tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(scan, _SENT_SCHEMA)
    dealt = tokens.unionByName(_packed_model(model, shards, copies)).repartition("part").sortWithinPartitions("part", "tokens")
    sums = dealt.mapInArrow(join, "batch long, x binary, y binary, z binary")
    return sums.groupBy("batch").applyInArrow(merge, held.add("n_tokens", "long").add("log10_prob", "double"))


def quantiles(scores: DataFrame, share: float, step: float = 0.001) -> DataFrame:
    """(lang, threshold): the least multiple of ``step`` at or below which at least ``share``
    of a language's log10 perplexities lie, from a whole histogram. Rows of null perplexity
    count for nothing; an empty table gives no rows."""
    bins = scores.where("log10_ppl is not null").groupBy("lang", F.ceil(F.col("log10_ppl") / step).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")  # some thousand bins a language, whatever the rows
    upto = F.sum("n").over(w.orderBy("bin"))
    return bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where(F.col("upto") >= share * F.col("all")).groupBy("lang").agg((F.min("bin") * step).alias("threshold"))


def _judge(docs: DataFrame, labels: DataFrame, row: str, id_col: str, text_col: str, lang_col: str, max_train_docs: int, max_train_bytes: int, share: float, slack: float) -> DataFrame:
    """(id, row, lang, n_tokens, log10_prob, perplexity, threshold, keep); ``row`` is a struct
    column of ``docs`` that holds the id."""
    arrow_rows(docs.sparkSession)
    verdicts = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")).where("good").select(id_col)
    trusted = materialize(docs.select(id_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"), F.octet_length(text_col).alias("_size")).join(verdicts, id_col, "left_semi"), "trusted")
    half = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    fit_for = trusted.where(half & F.col("_size").between(1, max_train_bytes)).groupBy(id_col).agg(F.min("_lang").alias("_lang"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    salted = fit_for.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(64)))  # the first of each 64th, then of them
    first = salted.withColumn("_turn", F.row_number().over(Window.partitionBy("_lang", "_salt").orderBy(*order))).where(F.col("_turn") <= max_train_docs)
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy(*order))
    sample = first.withColumn("_turn", turn).where(F.col("_turn") <= max_train_docs).orderBy("_turn", F.xxhash64(id_col), id_col).limit(max_train_docs).collect()
    ids, langs = [r[id_col] for r in sample], sorted({r["_lang"] for r in sample})
    train = docs.where(F.col(id_col).isin(ids)).dropDuplicates([id_col]) if ids else docs.limit(0)
    model = materialize(fit(train, text_col, lang_col), "model")
    scores = materialize(score(docs, model, id_col=row, text_col=text_col, lang_col=lang_col).select(F.col("id").alias("row"), "lang", "n_tokens", "log10_prob", (-F.col("log10_prob") / F.col("n_tokens")).alias("log10_ppl")), "scores")
    discard(model)
    scores = scores.select(F.col(f"row.{id_col}").alias("id"), "row", "lang", "n_tokens", "log10_prob", "log10_ppl")
    chosen = F.col("id").isin(ids) if ids else F.lit(False)
    held_out = scores.where(~chosen).join(trusted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    cut = quantiles(held_out.withColumn("lang", F.coalesce("lang", F.lit(""))), share).where(F.col("lang").isin(langs) if langs else F.lit(False))
    joined = scores.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(cut.withColumnRenamed("lang", "_lang"), "_lang", "left").drop("_lang")
    limit = F.col("threshold") + slack / F.sqrt("n_tokens")
    return joined.select("id", "row", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), F.col("log10_ppl")).alias("perplexity"), F.pow(F.lit(10.0), F.col("threshold")).alias("threshold"), F.coalesce(F.col("log10_ppl") <= limit, F.lit(True)).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = 1024, max_train_bytes: int = 1 << 17, share: float = SHARE, slack: float = SLACK) -> DataFrame:
    """(id, lang, n_tokens, log10_prob, perplexity, threshold, keep) for each row of ``docs``.

    Trusted rows are those that ``labels`` calls of quality 1 and not toxic. The model is
    fitted on ``max_train_docs`` of one half of them among texts of at most ``max_train_bytes``,
    which bounds it; languages take turns, each with its rows of least hash. A language's threshold is the ``share`` quantile of
    the perplexities of all trusted rows outside that sample. A row is kept up to the
    threshold of its language plus ``slack`` / sqrt(n_tokens) in log10, since short texts
    scatter more. Rows of a language without a model or without trusted rows outside the
    sample have a null threshold and are kept; null texts are judged as empty ones. Null languages are one language; repeated rows are judged alike; label
    rows that disagree on an id make it untrusted; empty tables give no rows.
    """
    row = fresh(docs, "row")
    judged = _judge(docs.withColumn(row, F.struct(id_col)), labels, row, id_col, text_col, lang_col, max_train_docs, max_train_bytes, share, slack)
    return judged.drop("row").withColumnRenamed("id", docs.schema[id_col].name)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = 1024, max_train_bytes: int = 1 << 17, share: float = SHARE, slack: float = SLACK) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects. A verdict depends on language and
    text alone, so rows of null id, and rows that share an id, are judged each by its own."""
    key, row = fresh(docs, "text_key"), fresh(docs, "row")
    keyed = docs.withColumn(key, F.struct(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    judged = _judge(keyed.withColumn(row, F.struct(id_col, key)), labels, row, id_col, text_col, lang_col, max_train_docs, max_train_bytes, share, slack)
    bad = judged.where("not keep").select(F.col(f"row.{key}").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
