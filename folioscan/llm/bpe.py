"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash cuts texts into chunks at places that depend on the bytes nearby alone, so
documents that share a passage share its chunks. A chunk's own encoding holds wherever it
stands, but for its edges: there the pre-tokenizer or a merge may reach across. A chunk's
core lies between its first and last firm place (an ASCII blank behind a character surely not
blank) and is encoded once for each task. What is left at a join is encoded anew in a window
that takes in one piece of the core on either side; where the window's ids and those of both
pieces agree exactly, the join is repaired, else the window grows to the whole text.
Tokenizers for which firm places prove nothing are run over whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SLICE, SPACE, buffers, finishing, mix, powers, row_groups
from .workspace import arrow_rows

WINDOW, MASK = 24, (1 << 11) - 1
CORE_BYTES, JOIN_BYTES, MOST_WORDS, MOST_IDS, LEARN = 16 << 20, 8 << 20, 300_000, 4 << 20, 4096
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def firm_places(data: np.ndarray) -> np.ndarray:
    """Where an ASCII blank follows a printable ASCII character or a letter or sign of U+00C0 to U+00FF."""
    before = (data >= 33) & (data <= 126)
    before[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    return np.flatnonzero(SPACE[data[1:]] & before[:-1]) + 1


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places whose preceding WINDOW bytes hash to 0 under MASK, never inside a character."""
    found = []
    for a in range(0, max(0, len(data) - WINDOW), SLICE - WINDOW):
        part = data[a : a + SLICE]
        p, q = powers()
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=sums[1:])
        h = mix((sums[WINDOW:] - sums[:-WINDOW]) * q[: len(part) - WINDOW + 1])
        found.append(np.flatnonzero((h & np.uint64(MASK)) == 0) + WINDOW + a)
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def spans(size: int, firm: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, core) from 0 to ``size``: cores of chunks and the joins between them, all
    with firm ends."""
    firm = np.concatenate([[0], firm, [size]])
    edges = np.concatenate([[0], cuts, [size]])
    starts = firm[np.searchsorted(firm, edges[:-1], "left")]
    ends = firm[np.searchsorted(firm, edges[1:], "right") - 1]
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if a < b:
            if at < a:
                out.append((at, a, False))
            out.append((a, b, True))
            at = b
    if at < size:
        out.append((at, size, False))
    return out


def cuts_at_blanks(spec: str) -> bool:
    """Whether no token of this tokenizer can reach across a firm place: byte-level BPE under
    the usual expression, texts as they are, no added token with white space or trimming."""
    s = json.loads(spec)
    model, pre = s.get("model") or {}, s.get("pre_tokenizer") or {}
    plain = s.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    bpe = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk"))
    added = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for c in t["content"]) for t in s.get("added_tokens") or [])
    return bool(plain and bpe and added)


class Encoder:
    """Encodes texts with one tokenizer, keeping up to CORE_BYTES of cores, JOIN_BYTES of
    joins and about MOST_WORDS words it has met."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.local = cuts_at_blanks(spec)
        self.forget()

    def forget(self) -> None:
        """Drop all that was kept; done after each task, since idle workers live on."""
        self.cores: dict[bytes, np.ndarray] = {}
        self.core_bytes = 0
        self.joins: dict[tuple, np.ndarray] = {}
        self.join_bytes = 0
        self.forget_words()

    def forget_words(self) -> None:
        self.words: dict[int, int] = {}
        self.check = np.zeros(1 << 14, np.uint64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, keys: list[int], checks: list[int], texts: list[str]) -> None:
        for a in range(0, len(texts), LEARN):
            got = self.tokenizer.encode_batch(texts[a : a + LEARN], add_special_tokens=False)
            self._store(keys[a : a + LEARN], checks[a : a + LEARN], got)

    def _store(self, keys: list[int], checks: list[int], got: list) -> None:
        for key, check, e in zip(keys, checks, got, strict=True):
            n = len(self.words)
            if n + 2 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                self.check = np.concatenate([self.check, np.zeros_like(self.check)])
            ids = e.ids
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.first[n + 1] = self.used
            self.words[key] = n
            self.check[n] = check

    def _pieces(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of consecutive pieces of at most a slice in all; all edges are firm."""
        if len(self.words) > MOST_WORDS or self.used > MOST_IDS:
            self.forget_words()
        starts, ends = edges[:-1], edges[1:]
        p, q = powers()
        body = data.astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(body * p[: len(data)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))
        np.cumsum(mix(body * _ODD2) * p[: len(data)], out=sums[1:])
        check = (sums[ends] - sums[starts]) * q[starts]
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        new = [i for i, key in zip(one.tolist(), h[one].tolist(), strict=True) if key not in self.words]
        if new:
            self._learn(h[new].tolist(), check[new].tolist(), [raw[starts[i] : ends[i]].decode() for i in new])
        where = np.array([self.words[k] for k in h[one].tolist()], np.int64)[inverse]
        same = self.check[where] == check
        lengths = self.first[where + 1] - self.first[where]
        off = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.first[where] - off[:-1], lengths) + np.arange(off[-1])]
        if not same.all():  # two pieces of one hash: encode the later one by itself
            parts = np.split(ids, off[1:-1])
            for i in np.flatnonzero(~same):
                parts[i] = np.array(self.tokenizer.encode(raw[starts[i] : ends[i]].decode(), add_special_tokens=False).ids, np.int32)
            off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            ids = np.concatenate(parts)
        return ids, off

    def _encode_spans(self, data: np.ndarray, todo: list[tuple[int, int]], firm: np.ndarray) -> list[np.ndarray]:
        """ids of each span [a, b) of ``data``."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(todo):
            j, size = i, 0
            while j < len(todo) and (j == i or size + todo[j][1] - todo[j][0] <= SLICE):
                size += todo[j][1] - todo[j][0]
                j += 1
            if size > SLICE:  # one long span: the tokenizer alone
                a, b = todo[i]
                out.append(np.array(self.tokenizer.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int32))
                i = j
                continue
            at, edges, heads = 0, [], [0]
            for a, b in todo[i:j]:
                inner = firm[np.searchsorted(firm, a, "right") : np.searchsorted(firm, b, "left")]
                edges.append(np.concatenate([[a], inner]) - a + at)
                at += b - a
                heads.append(heads[-1] + len(edges[-1]))
            whole = np.concatenate([data[a:b] for a, b in todo[i:j]])
            ids, off = self._pieces(whole, np.concatenate([*edges, [at]]).astype(np.int64))
            out += np.split(ids, off[heads[1:-1]])
            i = j
        return out

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """ids of each row."""
        raw = memoryview(data)
        if not self.local:
            return self._whole([bytes(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)])
        rows: list[list] = []
        todo: list[tuple[int, int]] = []
        keys: list[bytes | None] = []
        wanted: dict[bytes, int] = {}
        windows: dict[tuple, tuple[int, int, int, int, int]] = {}
        firm_all = []
        for n, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            part = data[a:b]
            firm = firm_places(part) if b - a > 1 else np.zeros(0, np.int64)
            firm_all.append(firm + a)
            places = np.concatenate([[0, 0], firm, [b - a, b - a]])
            row: list = []
            for s, e, core in spans(b - a, firm, cut_places(part)) if b > a else []:
                if core:
                    key = hashlib.blake2b(raw[a + s : a + e], digest_size=16).digest()
                    if key in self.cores:
                        row.append(self.cores[key])
                        continue
                    if key not in wanted:
                        wanted[key] = len(todo)
                        todo.append((a + s, a + e))
                        keys.append(key)
                    row.append(wanted[key])
                else:  # one piece more on either side
                    first = int(places[max(0, np.searchsorted(places, s, "left") - 1)])
                    last = int(places[min(len(places) - 1, np.searchsorted(places, e, "right"))])
                    key = (bytes(raw[a + first : a + last]), s - first, e - first)
                    if key not in self.joins and key not in windows:
                        windows[key] = (a + first, a + s, a + e, a + last, n)
                    row.append(key)
            rows.append(row)
        edges = [(p, q) for first, s, e, last, _ in windows.values() for p, q in ((first, s), (e, last))]
        inner = [x for x in edges if x[0] < x[1]]
        got = self._encode_spans(data, todo + inner, np.concatenate(firm_all)) if todo or inner else []
        given = iter(got[len(todo) :])
        sides = [next(given) if p < q else np.zeros(0, np.int32) for p, q in edges]
        odd: set[int] = set()
        fixed: dict[tuple, np.ndarray] = {}
        for k, (key, ids) in enumerate(zip(windows, self._whole([key[0] for key in windows]), strict=True)):
            left, right = sides[2 * k], sides[2 * k + 1]
            fixed[key] = ids[len(left) : len(ids) - len(right)]
            if not (np.array_equal(ids[: len(left)], left) and np.array_equal(ids[len(ids) - len(right) :], right)):
                odd.add(windows[key][4])
        out = []
        for n, row in enumerate(rows):
            parts = [got[x] if isinstance(x, int) else x if isinstance(x, np.ndarray) else self.joins[x] if x in self.joins else fixed[x] for x in row]
            if odd and any(isinstance(x, tuple) and x in windows and windows[x][4] in odd for x in row):
                parts = self._whole([bytes(raw[off[n] : off[n + 1]])])
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        for key, ids in zip(keys, got, strict=False):
            if self.core_bytes > CORE_BYTES:
                self.cores, self.core_bytes = {}, 0
            self.cores[key] = ids.copy()
            self.core_bytes += ids.nbytes + 200
        if self.join_bytes > JOIN_BYTES:
            self.joins, self.join_bytes = {}, 0
        if not odd:
            for key, ids in fixed.items():
                if len(key[0]) < 4096:
                    self.joins[key] = ids.copy()
                    self.join_bytes += len(key[0]) + ids.nbytes + 400
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """This worker's encoder for a tokenizer file's text; between tasks it keeps the tokenizer alone."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(spec)
    return _ENCODERS[name]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(spec: str) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    alphabet = byte_alphabet()
    added = tokenizer.get_added_tokens_decoder()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        plain = i in added or any(c not in alphabet for c in token)
        out[i] = token.encode() if plain else bytes(alphabet[c] for c in token)
    return out


def read_spec(path: str) -> str:
    """A tokenizer file's text; its size is that of a vocabulary, a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoding(held: Broadcast, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) batches to (name, ids)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(held.value)
        try:
            for b in finishing(batches):
                data, off = buffers(b.column(1))
                for i, j in row_groups(off):
                    got = e.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got), pa.int32()))], [name, "ids"])
        finally:
            e.forget()

    return go


def _decoding(held: Broadcast, ids_col: str, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the text of their ids as a last column."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            column = b.column(b.schema.get_field_index(ids_col))
            off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            off = off.astype(np.int64)
            a = 0
            while a < b.num_rows:
                z = min(b.num_rows, max(a + 1, int(np.searchsorted(off, off[a] + (1 << 19), "right")) - 1))
                texts = []
                for s, e, valid in zip(off[a:z].tolist(), off[a + 1 : z + 1].tolist(), column.slice(a, z - a).is_valid().to_pylist(), strict=True):
                    ids = values[s:e]
                    if valid and len(ids) and (ids.max() >= len(table) or ids.min() < 0):
                        ids = ids[(ids >= 0) & (ids < len(table))]
                    texts.append(b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace") if valid else None)
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])
                a = z

    return go


def _id_name(docs: DataFrame, id_col: str, *taken: str) -> str:
    """The id's name in the result, with underscores before it if it clashes with ``taken``."""
    name = docs.schema[id_col].name
    while name.lower() in taken:
        name = "_" + name
    return name


def encode(docs: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, as the tokenizers library encodes it without
    adding special tokens. Null and empty texts have no ids; null ids and repeated rows pass
    through; an empty table gives no rows; other columns are left out; an id column called
    ids comes back as _ids."""
    arrow_rows(docs.sparkSession)
    name = _id_name(docs, id_col, "ids")
    held = docs.sparkSession.sparkContext.broadcast(spec)
    return docs.select(id_col, text_col).mapInArrow(_encoding(held, name), f"`{name}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, spec: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids. Null ids arrays give null; ids beyond the
    vocabulary give nothing; bytes that are no UTF-8 become U+FFFD, as in the library; a
    column of the text's name is replaced."""
    held = encoded.sparkSession.sparkContext.broadcast(token_bytes(spec))
    rest = [c for c in encoded.columns if c != text_col]
    schema = encoded.select(*rest).schema.add(text_col, "string")
    return encoded.select(*rest).mapInArrow(_decoding(held, ids_col, text_col), schema)


def round_trip(docs: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): ``decode`` of ``encode`` in one pass, so one Python worker a task."""
    arrow_rows(docs.sparkSession)
    name = _id_name(docs, id_col, "ids", "text")
    to, back = _encoding(docs.sparkSession.sparkContext.broadcast(spec), name), _decoding(docs.sparkSession.sparkContext.broadcast(token_bytes(spec)), "ids", "text")
    return docs.select(id_col, text_col).mapInArrow(lambda batches: back(to(batches)), f"`{name}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row: the number of ids, the digest
    of the ids as decimals joined by commas and that of the text decoded from them. Null and
    empty texts have no ids and the digests of the empty string; rows may repeat, ids may be
    null, other columns play no part, and an empty table gives no rows."""
    both = round_trip(docs, spec, id_col=id_col, text_col=text_col)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(both.columns[0], F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
