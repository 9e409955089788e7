"""Many spellings of secrets looked for in texts in one pass over their bytes."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import functions as F

WIDTH = 8  # bytes of a key, a machine word
CHUNK = 1 << 18
LOAD = 64  # slots a key
MOST_SLOTS = 1 << 24
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * _FACTOR) >> np.uint64(64 - bits)


class Spellings:
    """Distinct pairs of (origin, spelling), packed to be broadcast. A spelling is looked for by its
    first WIDTH bytes, all if it has fewer: the words that begin at each place of a text meet a
    filter of them, what passes meets the keys themselves, and last the spellings of that key,
    by their lengths."""

    def __init__(self, pairs: Iterable[tuple[str, bytes]], anew: bytes) -> None:
        self.codes: dict[str, int] = {}
        self.owners: dict[bytes, tuple[int, ...] | frozenset[int]] = {}
        self.anew: dict[int, list[bytes]] = defaultdict(list)  # spellings that may arise where one was replaced
        alone: dict[tuple, tuple] = {}
        several: dict[bytes, list[int]] = {}
        by_size: dict[int, dict[int, tuple[int, ...]]] = defaultdict(dict)
        for origin, form in pairs:
            code = self.codes.setdefault(origin, len(self.codes))
            if anew in form:
                self.anew[code].append(form)
            if form in self.owners:
                several.setdefault(form, [*self.owners[form]]).append(code)
                continue
            self.owners[form] = alone.setdefault((code,), (code,))
            keys, key = by_size[min(len(form), WIDTH)], int.from_bytes(form[:WIDTH], "little")
            lengths = tuple(sorted({*keys.get(key, ()), len(form)}))
            keys[key] = alone.setdefault(lengths, lengths)
        self.owners |= {f: frozenset(c) for f, c in several.items()}
        self.parts = []
        for size, of in sorted(by_size.items()):
            keys = np.array(sorted(of), dtype=np.uint64)
            bits = int(min(max(LOAD * len(keys), 1 << 12), MOST_SLOTS) - 1).bit_length()
            filled = np.zeros(1 << bits, dtype=bool)
            filled[_slots(keys, bits)] = True
            self.parts.append((size, bits, filled, keys, [of[k] for k in keys.tolist()]))

    def _spots(self, data: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(place, lengths) in ``data`` where a spelling may begin; WIDTH more bytes follow its end."""
        words = np.lib.stride_tricks.as_strided(data, (len(data) - WIDTH, WIDTH), (1, 1))
        for at in range(0, len(words), CHUNK):
            chunk = np.ascontiguousarray(words[at : at + CHUNK]).view("<u8").ravel()
            for size, bits, filled, keys, lengths in self.parts:
                own = chunk if size == WIDTH else chunk & np.uint64((1 << 8 * size) - 1)
                some = np.flatnonzero(filled[_slots(own, bits)])
                place = np.minimum(np.searchsorted(keys, own[some]), len(keys) - 1)
                met = keys[place] == own[some]
                for k, p in zip(some[met].tolist(), place[met].tolist(), strict=True):
                    yield at + k, lengths[p]

    def found(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, spelling) for each place of ``texts`` where a spelling of any origin stands."""
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(ends[0]), int(ends[-1])
        if first == last or not self.owners:
            return
        raw = memoryview(texts.buffers()[2])[first:last]
        data = np.concatenate([np.frombuffer(raw, dtype=np.uint8), np.zeros(WIDTH, dtype=np.uint8)])
        ends = (ends - first).tolist()
        for at, lengths in self._spots(data):
            row = bisect_right(ends, at) - 1
            for n in lengths:
                if at + n <= ends[row + 1] and (form := bytes(raw[at : at + n])) in self.owners:
                    yield row, form


def masked(held: Broadcast, mask: bytes):
    """A column function of (origin, text): the text with ``mask`` for each spelling of its own
    origin, longest first; null where none stands in it."""

    @F.arrow_udf("string")
    def go(origin: pa.Array, s: pa.Array) -> pa.Array:
        return _masked(held.value, mask, origin, s)

    return go


def masked_each(held: Broadcast, mask: bytes):
    """``masked`` of (origin, texts), with all the texts."""

    @F.arrow_udf("array<string>")
    def go(origin: pa.Array, lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        each = lists.flatten()
        new = pc.coalesce(_masked(held.value, mask, origin.take(pa.array(np.repeat(np.arange(len(lists)), sizes))), each), each)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), new, mask=lists.is_null())

    return go


def _masked(table: Spellings, mask: bytes, origin: pa.Array, s: pa.Array) -> pa.Array:
    held: dict[int, set[bytes]] = defaultdict(set)
    for row, form in table.found(s):
        if table.codes.get(origin[row].as_py()) in table.owners[form]:
            held[row].add(form)
    kind = pa.large_binary() if pa.types.is_large_string(s.type) else pa.binary()
    raw, out = s.cast(kind), [None] * len(s)
    for row, forms in held.items():
        t = raw[row].as_py()
        for f in sorted({*forms, *table.anew.get(table.codes[origin[row].as_py()], ())}, key=lambda f: (-len(f), f)):
            t = t if t is None else t.replace(f, mask)
        out[row] = t
    return pa.array(out, kind).view(s.type)


def shown(held: Broadcast):
    """A column function of (origin, text): whether a spelling of another origin stands in the text."""

    @F.arrow_udf("boolean")
    def go(origin: pa.Array, s: pa.Array) -> pa.Array:
        table, out = held.value, np.zeros(len(s), dtype=bool)
        for row, form in table.found(s):
            if not out[row] and origin[row].is_valid and s[row].is_valid:
                code = table.codes.get(origin[row].as_py())
                out[row] = any(c != code for c in table.owners[form])
        return pa.array(out)

    return go
