"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word's edits are generated as hashes and probed in broadcast filters, one for each
word length, whose blocks are single 64-bit words. Only edits that pass become strings and
are shuffled, to an exact join with the vocabulary that removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import buffers, finishing, mix, row_groups
from .workspace import arrow_rows, discard, materialize

RUN = "[a-zÀ-ÿ]"
LONG = 64
KEYS_A_BLOCK = 4
SEGMENT_KEYS = 1 << 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def damaged_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6) -> DataFrame:
    """(word): every letter run of every whole text, A-Z lower-cased, with the planted slips:
    where ``every`` divides h, the crc32 of ``<id>:<run>``, the run lacks its code point
    h % length. Words of fewer than ``least_length`` code points are left out. Null texts
    hold none; a null id counts as the text ''; other columns play no part."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n): distinct words with at least ``least`` occurrences; null words are left out."""
    return words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a column of strings, and where each string begins."""
    data, off = buffers(column)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64), at[off]


class Spelled:
    """The polynomials of consecutive words, and what is needed to change one of a word's
    code points: its position's power and the sum before it."""

    def __init__(self, column: pa.Array):
        self.cp, self.at = code_points(column)
        n = np.diff(self.at)
        self.length = n
        self.word = np.repeat(np.arange(len(n)), n)
        self.pos = np.arange(len(self.cp)) - self.at[:-1][self.word]
        powers = np.full(int(n.max(initial=0)) + 1, _BASE, np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[self.pos]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.cp + np.uint64(1)) * self.power)])
        start = sums[self.at[:-1]]
        self.total = sums[self.at[1:]] - start
        self.before = sums[:-1] - start[self.word]
        self.after = self.total[self.word] - (sums[1:] - start[self.word])

    def keys(self) -> np.ndarray:
        return mix(self.total)

    def without(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of all distinct words with one code point less; of equal
        neighbours only the first is left out."""
        first = np.ones(len(self.cp), bool)
        first[1:] = (self.cp[1:] != self.cp[:-1]) | (self.pos[1:] == 0)
        j = np.flatnonzero(first)
        return j, mix(self.before[j] + self.after[j] * _INVERSE)

    def replaced(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the words with a smaller code point replaced by ``letter``:
        each pair of words that differ in one place comes from the smaller one."""
        j = np.flatnonzero(self.cp < np.uint64(letter))
        return j, mix(self.total[self.word[j]] + (np.uint64(letter) - self.cp[j]) * self.power[j])


def _block(keys: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.asarray(blocks, np.uint64)).astype(np.int64)


def _mask(keys: np.ndarray) -> np.ndarray:
    """Four of a block's 64 bits."""
    h, one, out = mix(keys ^ _BASE), np.uint64(1), np.zeros(len(keys), np.uint64)
    for k in range(4):
        out |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _part(keys: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFF)) % np.asarray(parts, np.uint64)).astype(np.int64)


class Filters:
    """The blocked filters of one round. Lengths of 64 and more share one; a length of many
    words is cut into parts by hash; parts of other rounds hold nothing."""

    def __init__(self, parts: np.ndarray, blocks: dict[int, bytes]):
        self.parts = np.maximum(parts, 1)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])[:-1]
        total = int(self.parts.sum())
        self.size, self.base = np.zeros(total, np.int64), np.zeros(total, np.int64)
        at, held = 0, []
        for part, raw in sorted(blocks.items()):
            self.size[part], self.base[part] = len(raw) // 8, at
            at += len(raw) // 8
            held.append(raw)
        self.data = np.frombuffer(b"".join(held), np.uint64)

    def holds(self, keys: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Positions of the keys that may be words of the given lengths."""
        shard = np.minimum(length, LONG)
        part = self.first[shard] + _part(keys, self.parts[shard])
        here = np.flatnonzero(self.size[part] > 0)
        part, keys = part[here], keys[here]
        mask = _mask(keys)
        return here[(self.data[self.base[part] + _block(keys, self.size[part])] & mask) == mask]


def _filter_blocks(vocab: DataFrame, parts: np.ndarray) -> DataFrame:
    """(part, blocks): the filter of each part, 16 bits a word."""
    first = np.concatenate([[0], np.cumsum(np.maximum(parts, 1))])[:-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spelled = Spelled(b.column("word"))
            keys, shard = spelled.keys(), np.minimum(spelled.length, LONG)
            part = first[shard] + _part(keys, np.maximum(parts, 1)[shard])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys.view(np.int64))], ["part", "k"])

    def build(t: pa.Table) -> pa.Table:
        keys = t.column("k").to_numpy().view(np.uint64)
        blocks = np.zeros(len(keys) // KEYS_A_BLOCK + 1, np.uint64)
        np.bitwise_or.at(blocks, _block(keys, len(blocks)), _mask(keys))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "blocks": [blocks.tobytes()]})

    return vocab.select("word").mapInArrow(deal, "part int, k long").groupBy("part").applyInArrow(build, "part int, blocks binary")


def _probed(vocab: DataFrame, filters, alphabet: list[int]) -> DataFrame:
    """(word, n, other): words with those of their edits that pass the filters."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for b in finishing(batches):
            _, off = buffers(b.column("word"))
            for i, j in row_groups(off):
                column = b.column("word").slice(i, j - i)
                words, spelled = column.to_pylist(), Spelled(column)
                at, others = [], []
                p, keys = spelled.without()
                for x in p[held.holds(keys, spelled.length[spelled.word[p]] - 1)]:
                    r, k = int(spelled.word[x]), int(spelled.pos[x])
                    at.append(r), others.append(words[r][:k] + words[r][k + 1 :])
                for letter in alphabet:
                    p, keys = spelled.replaced(letter)
                    for x in p[held.holds(keys, spelled.length[spelled.word[p]])]:
                        r, k = int(spelled.word[x]), int(spelled.pos[x])
                        at.append(r), others.append(words[r][:k] + chr(letter) + words[r][k + 1 :])
                rows = pa.array(np.array(at, np.int64))
                yield pa.RecordBatch.from_arrays([column.take(rows), b.column("n").slice(i, j - i).take(rows), pa.array(others, pa.string())], ["word", "n", "other"])

    return vocab.select("word", "n").mapInArrow(go, "word string, n long, other string")


def near_pairs(vocab: DataFrame, filter_bytes: int = 64 << 20) -> DataFrame:
    """(word, near, near_n), both ways: vocabulary words that differ by exactly one inserted,
    deleted or replaced code point.

    ``vocab`` has distinct words (word, n). Filters take two bytes a word and are broadcast
    in rounds of at most ``filter_bytes``, each round probing all words for its part of the
    vocabulary; up to 32 million words that is one round.
    """
    spark: SparkSession = vocab.sparkSession
    sizes = np.zeros(LONG + 1, np.int64)
    for r in vocab.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("length")).count().collect():
        sizes[r[0]] = r[1]
    alphabet = sorted(r[0] for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().select(F.ascii("c")).collect() if r[0])
    parts = -(-sizes // SEGMENT_KEYS)
    of = np.repeat(np.arange(LONG + 1), np.maximum(parts, 1))
    weight = np.where(sizes[of] > 0, 2 * sizes[of] // np.maximum(parts[of], 1) + 8, 0)
    rounds: list[list[int]] = [[]]
    for part in np.flatnonzero(weight):
        if rounds[-1] and weight[rounds[-1]].sum() + weight[part] > filter_bytes:
            rounds.append([])
        rounds[-1].append(int(part))
    blocks = materialize(_filter_blocks(vocab, parts), "filters")
    out = None
    for mine in rounds:
        held = {r[0]: bytes(r[1]) for r in blocks.where(F.col("part").isin(mine)).collect()}
        filters = spark.sparkContext.broadcast(Filters(parts, held))
        found = _probed(vocab, filters, alphabet).join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        out = found if out is None else out.unionByName(found)
    pairs = materialize(out, "near")
    discard(blocks)
    return pairs.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")).unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variant_forms(vocab: DataFrame, *, factor: int = 5, filter_bytes: int = 64 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every vocabulary word.

    ``vocab`` has distinct words and their counts (word, n). The form is the near word of
    largest count (ties: the smallest in code-point order) if it has at least ``factor``
    times the word's; the root is reached by following forms to the last. Counts grow by
    ``factor`` with each step, so paths have at most log(largest count) steps and halving
    them needs a few joins, whose number the largest count tells. Words without near words
    have none; an empty vocabulary gives no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    arrow_rows(vocab.sparkSession)
    vocab = materialize(vocab.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(vocab, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    forms = vocab.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    has: Column = F.col("form_n") >= factor * F.col("n")
    forms = materialize(forms.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    low, high = vocab.agg(F.min("n"), F.max("n")).first()
    steps, top = 0, low or 1
    while top * factor <= (high or 0):
        top, steps = top * factor, steps + 1
    path = forms.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ahead = path.select(F.col("word").alias("root"), F.col("root").alias("next"))
        path = materialize(path.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    discard(vocab)
    return forms.join(path, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
