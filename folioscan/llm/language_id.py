"""Language identification by bit-sliced Bloom filters of character n-grams.

A slot of the filter is a mask with one bit for each language. An n-gram sets its languages'
bits in its four slots; the AND of those slots returns, in one look-up, all languages that
hold the n-gram. A text's hits are counted for each language, each count is freed of the
share that the filter's own false positives put there, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .kernels import SLICE, buffers, finishing, mix, row_groups
from .workspace import arrow_rows, discard, materialize

SIZES = (3, 4)
HASHES = 4
SLOTS_PER_GRAM = 10
UNKNOWN = "und"
MOST_LANGUAGES = 4096
_HELD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def letters(text: Column) -> Column:
    """Lower-case words of letters and marks, one space around each; null reads as empty."""
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " "))), F.lit(" "))


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes in which n-grams start): consecutive rows of a slice,
    or a slice of a longer row with what its last n-grams need of the next."""
    for i, j in row_groups(off, SLICE):
        a, end = int(off[i]), int(off[j])
        if end - a <= SLICE:
            yield data[a:end], off[i : j + 1] - a, i, end - a
            continue
        while a < end:
            b = min(end, a + SLICE)
            while b < end and data[b] & 0xC0 == 0x80:
                b += 1
            c, more = b, max(SIZES) - 1
            while c < end and more >= 0:
                more -= int(data[c] & 0xC0 != 0x80)
                c += more >= 0
            yield data[a:c], np.array([0, c - a]), i, b - a
            a = b


def grams(data: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of the n-grams of rows that ``letters`` made and that start below byte
    ``most``. A space stands at an n-gram's edge only, so none reaches from row to row."""
    starts = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(starts)])
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blanks = np.concatenate([[0], np.cumsum(cp == 32)])
    first, limit = at[off], int(at[most])
    keys, rows = [], []
    for n in SIZES:
        m = min(len(cp) - n + 1, limit)
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * _ODD + cp[j : j + m]
        here = np.flatnonzero(blanks[n - 1 : n - 1 + m] == blanks[1 : 1 + m])
        keys.append(mix(h[here]))
        rows.append(np.searchsorted(first, here, "right") - 1)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(rows: DataFrame) -> DataFrame:
    """(k, lang, n): how often the training rows of a language hold an n-gram. ``rows`` has
    (text, lang), the text from ``letters``, the language a number. A task adds up what it
    meets before it sends it, a million n-grams at most."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def pour() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for a in range(0, len(k), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(k[b].view(np.int64)), pa.array(np.full(len(k[b]), lang, np.int32)), pa.array(n[b])], ["k", "lang", "n"])
            held.clear()

        for batch in finishing(batches):
            data, off = buffers(batch.column("text"))
            langs = batch.column("lang").to_numpy()
            for raw, at, row, most in _pieces(data, off):
                keys, rows = grams(raw, at, most)
                of = langs[row + rows]
                for lang in np.unique(of):
                    held.setdefault(int(lang), []).append(np.unique(keys[of == lang], return_counts=True))
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2 * _HELD:
                for lang, parts in held.items():
                    held[lang] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                if sum(len(parts[0][0]) for parts in held.values()) > _HELD:
                    yield from pour()
        yield from pour()

    return rows.select("text", "lang").mapInArrow(go, "k long, lang int, n long").groupBy("k", "lang").agg(F.sum("n").alias("n"))


def admitted(counts: DataFrame, totals: DataFrame, floor: float, share: float) -> DataFrame:
    """(k, lang): the languages that hold an n-gram: at least ``floor`` of the language's
    n-grams, and at least ``share`` of its rate where it is most frequent. So a language
    holds at most 1 / floor n-grams."""
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= floor)
    most = F.max("rate").over(Window.partitionBy("k"))
    return rated.withColumn("most", most).where(F.col("rate") >= share * F.col("most")).select("k", "lang")


class Slices:
    """The bit-sliced filter: ``masks`` has a row of language bits for each slot."""

    def __init__(self, parts: dict[int, bytes], shards: int, slots: int, languages: list[str], fallback: int):
        self.shards, self.slots, self.languages, self.fallback = shards, slots, languages, fallback
        width = (len(languages) + 7) // 8
        self.masks = np.zeros((shards * slots, width), np.uint8)
        rate = np.zeros(len(languages))
        for s in range(shards):
            if s in parts:
                part = np.frombuffer(parts[s], np.uint8).reshape(slots, width)
                self.masks[s * slots : (s + 1) * slots] = part
                filled = np.concatenate([np.bincount(part[:, b], minlength=256) @ _BITS for b in range(width)])
                rate += (filled[: len(languages)] / slots) ** HASHES
        self.false_rate = rate / shards

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """A row of language bits for each key."""
        base = (keys % np.uint64(self.shards)).astype(np.int64) * self.slots
        out = self.masks[base + slot(keys, 0, self.slots)]
        for k in range(1, HASHES):
            out &= self.masks[base + slot(keys, k, self.slots)]
        return out

    def hits(self, keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """How many keys of each of n rows each language holds."""
        masks = self.languages_of(keys)
        found = [np.bincount(rows * 256 + masks[:, b], minlength=n * 256).reshape(n, 256) @ _BITS for b in range(masks.shape[1])]
        return np.concatenate(found, axis=1)[:, : len(self.languages)]

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, share of the text's n-grams that it truly holds). Of n n-grams, h true
        ones show as h + (n - h) * rate hits."""
        n = np.maximum(n, 1)[:, None]
        true = np.clip((hits - n * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9) / n, 0, 1)
        best = true.argmax(axis=1)
        score = true[np.arange(len(best)), best]
        return np.where(score > 0, best, self.fallback), score


def slot(keys: np.ndarray, k: int, slots: int) -> np.ndarray:
    return (mix(keys ^ _SEEDS[k]) % np.uint64(slots)).astype(np.int64)


def fit(rows: DataFrame, *, floor: float = 1e-6, share: float = 0.5, filter_bytes: int = 64 << 20) -> Slices | None:
    """The filter learned from every row of (text, lang), texts from ``letters``.

    It takes ten slots for each n-gram of the language that holds most, but never more than
    ``filter_bytes``: with many languages false positives rise and are corrected for. It is
    None where there is no language. More than 4096 distinct languages are an error.
    """
    spark: SparkSession = rows.sparkSession
    shards = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not seen:
        return None
    languages = [r[0] for r in seen]
    numbered = rows.join(F.broadcast(spark.createDataFrame(list(enumerate(languages)), "number int, lang string")), "lang").select("text", F.col("number").alias("lang"))
    counts = materialize(count_grams(numbered), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()  # a row for each language
    known = materialize(admitted(counts, spark.createDataFrame([tuple(r) for r in totals], "lang int, total long"), floor, share), "admitted")
    width = (len(languages) + 7) // 8
    largest = max((r[1] for r in known.groupBy("lang").count().collect()), default=0)
    slots = max(64, min(SLOTS_PER_GRAM * largest // shards + 1, filter_bytes // (shards * width)))

    def build(t: pa.Table) -> pa.Table:
        keys, langs = t.column("k").to_numpy().view(np.uint64), t.column("lang").to_numpy()
        bits = np.zeros((slots, width), np.uint8)
        for k in range(HASHES):
            np.bitwise_or.at(bits, (slot(keys, k, slots), langs >> 3), np.left_shift(1, langs & 7).astype(np.uint8))
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "bits": [bits.tobytes()]})

    wrap = F.when(F.col("k") < 0, (1 << 64) % shards).otherwise(0)  # k read as unsigned
    shard = ((F.pmod("k", F.lit(shards)) + wrap) % shards).cast("int")
    built = known.select(shard.alias("shard"), "k", "lang").groupBy("shard").applyInArrow(build, "shard int, bits binary").collect()  # filter_bytes at most
    discard(counts)
    discard(known)
    fallback = min(range(len(seen)), key=lambda i: (-seen[i][1], languages[i]))
    return Slices({r[0]: bytes(r[1]) for r in built}, shards, slots, languages, fallback)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 3, held_out_rest: int = 1, floor: float = 1e-6, share: float = 0.5, filter_bytes: int = 64 << 20) -> DataFrame:
    """(id, held_out, lang_pred, score, n_grams) of every whole text.

    Rows whose crc32 of the id as text leaves ``held_out_rest`` by ``held_out_mod`` are held
    out; all others of non-null language train. Only the text decides. ``score`` is the share
    of the text's n-grams (3 and 4 characters within words, padded) that the language holds,
    freed of false positives. Ties go to the smaller language; texts of which no language
    holds an n-gram get the language of most training rows and score 0. A text that is null
    or holds no letter, and any text where nothing could be learned, is ``und`` with score 0.
    A null id counts as the text ''; repeated rows each count; columns besides these three
    play no part; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark)
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (crc % held_out_mod == held_out_rest).alias("held_out"))
    model = fit(rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select(letters(F.col("text")).alias("text"), "lang"), floor=floor, share=share, filter_bytes=filter_bytes)
    shared = spark.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ready = rows.select("id", "held_out", has_letter.alias("has_letter"), F.when(has_letter, letters(F.col("text"))).otherwise("").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in finishing(batches):
            data, off = buffers(batch.column("text"))
            size = len(off) - 1
            pred, score, n = np.full(size, UNKNOWN, object), np.zeros(size), np.zeros(size, np.int64)
            if model is not None:
                hits = np.zeros((size, len(model.languages)), np.int64)
                for raw, at, row, most in _pieces(data, off):
                    keys, rows = grams(raw, at, most)
                    here = len(at) - 1
                    hits[row : row + here] += model.hits(keys, rows, here)
                    n[row : row + here] += np.bincount(rows, minlength=here)
                best, score = model.decide(hits, n)
                known = batch.column("has_letter").to_numpy(zero_copy_only=False)
                pred[known] = np.array(model.languages, object)[best[known]]
                score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(n)], ["id", "held_out", "lang_pred", "score", "n_grams"])

    schema = StructType([ready.schema["id"], ready.schema["held_out"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_grams", LongType())])
    return ready.mapInArrow(go, schema).withColumnRenamed("id", id_col)
