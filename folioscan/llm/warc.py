"""WARC archives: one gzip member for each record, written and read back by Spark.

Spark has no binary sink, but its text sink writes a row's bytes as they are and then a
separator. A gzip member ends with its length's highest byte, which is zero below 16 MiB,
so the sink gets each member without that byte and writes it as the separator. The files
are plain ``.warc.gz`` streams on any store that Spark can write, under Spark's committer.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import arrow_rows, discard, materialize

WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ID = "urn:page:"
READ_SCHEMA = "file string, record_id string, page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, size, leader) for each row.

    Of equal payloads of at least ``least`` bytes the row with the largest id leads and the
    others revisit it. A null payload is empty; rows that repeat the leader's id lead too;
    rows of null id never lead unless all copies are of null id, and then all are responses.
    Only groups of copies are joined back, and digests are counted on the map side first.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    leaders = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(leaders, ["digest", "size"], "left")


def _record(kind: str, rid: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", WARC_DATE), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, leader: int | None) -> bytes:
    """The WARC record of one page; a revisit holds the HTTP head alone."""
    revisit = leader is not None and leader != page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url))] if url is not None else []
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_ID}{leader}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record("revisit" if revisit else "response", f"{_ID}{'none' if page_id is None else page_id}", head if revisit else head + payload, headers)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[bytes] = []
        held = 0
        for page_id, url, payload, digest, leader in zip(*(b.column(k) for k in ("page_id", "url", "payload", "digest", "leader")), strict=True):
            out.append(_member(page_record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), leader.as_py())))
            held += len(out[-1])
            if held > 1 << 24:
                yield _tails(out)
                out, held = [], 0
        if out:
            yield _tails(out)


def _tails(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in members], pa.binary()), pa.array([m[-1] for m in members], pa.int32())], ["body", "tail"])


def write_warc(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write ``plan_records`` rows as archives under ``path``, one folder for each last byte
    of members (0 but for records of 16 MiB or more)."""
    arrow_rows(records.sparkSession)
    wide = (F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0)) * 3 + 4096) >= (1 << 24)

    def put(rows: DataFrame, tail: int) -> None:
        rows.select(F.col("body").cast("string").alias("value")).write.option("lineSep", chr(tail)).option("maxRecordsPerFile", records_per_file).mode("append").text(f"{path}/tail={tail}")

    small = records.where(~wide).withColumn("payload", F.col("payload").cast("binary"))
    put(small.mapInArrow(_members, "body binary, tail int"), 0)
    if records.where(wide).limit(1).count():
        large = materialize(records.where(wide).withColumn("payload", F.col("payload").cast("binary")).mapInArrow(_members, "body binary, tail int"), "wide")
        for (tail,) in large.select("tail").distinct().collect():  # at most 128 values
            put(large.where(F.col("tail") == tail), tail)
        discard(large)


class _Stream:
    """Pulls one record at a time out of concatenated gzip members, piece by piece; ``raw``
    holds the compressed bytes of the member at hand."""

    def __init__(self, pieces: Iterator[bytes | memoryview]):
        self.pieces = iter(pieces)
        self.rest: bytes | memoryview = b""
        self.raw: list[bytes] = []

    def more(self, between: bool = False) -> bool:
        """Whether bytes are left; ``between`` members zero bytes are padding, as for gzip."""
        while True:
            if between and len(self.rest) and self.rest[0] == 0:
                self.rest = bytes(self.rest).lstrip(b"\0")
            if len(self.rest):
                return True
            self.rest = next(self.pieces, None)
            if self.rest is None:
                self.rest = b""
                return False

    def plain(self) -> bool:
        """Whether the bytes are a WARC file that something else has decompressed."""
        while len(self.rest) < 5 and (piece := next(self.pieces, None)) is not None:
            self.rest = bytes(self.rest) + bytes(piece)
        return bytes(self.rest[:5]) == b"WARC/"

    def record(self) -> Iterator[bytes]:
        """The bytes of one record of such a file."""
        got = bytearray()
        self.raw = []
        while (end := got.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise EOFError("archive ends inside a record")
            got += self.rest
            self.rest = b""
            self.raw = [bytes(got)]
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(got[:end]).replace(b"\r", b""))
        left = end + 8 + int(length[1] if length else 0) - len(got)
        yield bytes(got[: len(got) + min(0, left)])
        self.rest = bytes(got[len(got) + left :]) if left < 0 else b""
        while left > 0:
            if not self.more():
                raise EOFError("archive ends inside a record")
            block, self.rest = self.rest[:left], self.rest[left:]
            left -= len(block)
            self.raw.append(bytes(block))
            yield bytes(block)

    def member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        self.raw = []
        while not z.eof:
            if not self.more():
                raise EOFError("archive ends inside a member")
            block, self.rest = self.rest[:BLOCK], self.rest[BLOCK:]
            got = z.decompress(block)
            if z.eof and z.unused_data:
                used = len(block) - len(z.unused_data)
                self.rest = bytes(block[used:]) + bytes(self.rest) if len(self.rest) else bytes(block[used:])
                block = block[:used]
            self.raw.append(bytes(block))
            yield got


def _blocks(data: memoryview) -> Iterator[memoryview]:
    for a in range(0, len(data), BLOCK):
        yield data[a : a + BLOCK]


def read_records(data: bytes | memoryview | _Stream) -> Iterator[dict]:
    """The records of one archive, in order. A record whose framing, length or digest is
    wrong comes with ``error`` set; bytes that are no gzip member end the archive with an
    error record, since nothing says where the next member would begin."""
    stream = data if isinstance(data, _Stream) else _Stream(_blocks(memoryview(data)))
    plain = stream.plain()
    while stream.more(between=True):
        out: dict = {"error": None, "headers": {}, "payload": b""}
        try:
            parts = stream.record() if plain else stream.member()
            got = bytearray()
            while (end := got.find(b"\r\n\r\n")) < 0:
                got += next(parts)
            version, *lines = got[:end].decode("utf-8").split("\r\n")
            out["headers"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(out["headers"]["content-length"])
            block = got[end + 4 :]
            for part in parts:
                block += part
            if not version.startswith("WARC/"):
                out["error"] = "version"
            elif block[length:] != b"\r\n\r\n":
                out["error"] = "length"
            block = bytes(block[:length])
            if not out["error"] and out["headers"].get("warc-block-digest", _digest(block)) != _digest(block):
                out["error"] = "block digest"
            head, _, body = block.partition(b"\r\n\r\n")
            out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            out["payload"] = body
            if not out["error"] and out["headers"].get("warc-type") == "response" and out["headers"].get("warc-payload-digest", _digest(body)) != _digest(body):
                out["error"] = "payload digest"
        except (ValueError, KeyError, StopIteration, zlib.error, EOFError) as e:
            yield out | {"error": f"{type(e).__name__}: {e}"}
            if isinstance(e, (zlib.error, EOFError)):
                return
            for _ in parts:  # to the member's end
                pass
            continue
        yield out


def _page_of(uri: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?\d+)>", uri or "")
    return int(m[1]) if m else None


_NAMES = [f.split(" ")[0] for f in READ_SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
_SPLIT_SCHEMA = READ_SCHEMA + ", block long, head binary, tail binary, starts boolean"
MAGIC = b"\x1f\x8b\x08"


def _row(file: str, r: dict, payloads: bool) -> tuple:
    h = r["headers"]
    digest = h.get("warc-payload-digest", "")
    hexed = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") and len(digest) == 37 else None
    kind = h.get("warc-type")
    size = int(r["http"].get("content-length", len(r["payload"]))) if kind == "revisit" and r.get("http") else len(r["payload"])
    return (file, h.get("warc-record-id"), _page_of(h.get("warc-record-id")), h.get("warc-target-uri"), kind, _page_of(h.get("warc-refers-to")), size, hexed, r["payload"] if payloads else None, r["error"])


def _packed(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of at most some 8 MB of payload."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += 200 + len(row[8] or b"")
        if held > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _first_member(pieces: Iterator[bytes]) -> tuple[bytes, Iterator[bytes]]:
    """(what precedes the first member that opens a WARC record, the bytes from there on).

    Three bytes alone may stand in compressed data, so a place counts only if it inflates to
    the word that every record begins with.
    """
    seen = bytearray()
    at = 0
    for piece in pieces:
        seen += piece
        while (found := seen.find(MAGIC, at)) >= 0:
            if len(seen) - found < 64:
                at = found
                break  # too little yet to tell
            try:
                if zlib.decompressobj(31).decompress(seen[found : found + 4096], 5) == b"WARC/":
                    rest = bytes(seen[found:])
                    return bytes(seen[:found]), itertools.chain([rest], pieces)
            except zlib.error:
                pass
            at = found + 1
        else:
            at = max(at, len(seen) - 2)
    at = max(0, len(seen) - 64)
    while (found := seen.find(MAGIC, at)) >= 0:  # a member cut off within its first bytes
        try:
            zlib.decompressobj(31).decompress(seen[found:])
            return bytes(seen[:found]), iter([bytes(seen[found:])])
        except zlib.error:
            at = found + 1
    return bytes(seen), iter(())


def _split_rows(file: str, block: int, pieces: Iterator[bytes], payloads: bool) -> Iterator[tuple]:
    """Records that begin and end inside one split of a file, then a row with what belongs to
    members that cross its ends."""
    head, rest = (b"", pieces) if block == 0 else _first_member(pieces)
    stream = _Stream(rest)
    starts, tail = False, b""
    for r in read_records(stream):
        starts = True
        if r["error"] and r["error"].startswith("EOFError"):
            tail = b"".join(stream.raw)
        else:
            yield (*_row(file, r, payloads), None, None, None, None)
    yield (file, *[None] * 9, block, head, tail, starts or block == 0)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below ``path``; without ``payloads`` that column is null.

    Archives of any size are read by splits, as text with a zero byte as line end: Spark
    streams the bytes between zero bytes to the workers, which put the zero bytes back, find
    the first member of their split and read on from there member by member. A member that
    crosses from one split to the next, or over several, is put together by a join of what
    the splits have left. Files that Hadoop decompresses by their name are read as they come. A record whose framing or digest is wrong has ``error`` set; an
    archive cut off within a member ends with such a record. No archives give no rows.
    """
    files = spark.read.option("lineSep", "\0").option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    lines = files.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), (meta["file_block_start"] + meta["file_block_length"]).alias("end"), meta["file_size"].alias("size"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            runs = _by_split(batches)
            for file, block, last, pieces in runs:
                yield from _split_rows(file, block, _with_zeros(pieces, last), payloads)

        yield from _packed(rows(), _SPLIT_NAMES, _SPLIT_KINDS)

    found = materialize(lines.mapInArrow(split, _SPLIT_SCHEMA), "records")
    whole = found.where("block is null").select(*_NAMES)
    ends = found.where("block is not null")
    if ends.where("block > 0 or length(tail) > 0").limit(1).count() == 0:
        return whole
    order = Window.partitionBy("file").orderBy("block")  # a row for each split, without bytes
    chains = ends.select("file", "block", F.sum(F.col("starts").cast("int")).over(order).alias("chain"))
    bits = ends.join(chains, ["file", "block"])
    heads = bits.where("length(head) > 0").select("file", "block", (F.col("chain") - F.col("starts").cast("int")).alias("chain"), F.col("head").alias("bytes"))
    tails = bits.where("length(tail) > 0").select("file", "block", "chain", F.col("tail").alias("bytes"))

    def stitch(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        rows = [_row(t.column("file")[0].as_py(), r, payloads) for r in read_records(b"".join(t.column("bytes").to_pylist()))]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(_NAMES, zip(*rows, strict=True), _KINDS, strict=True)})

    return whole.unionByName(heads.unionByName(tails).groupBy("file", "chain").applyInArrow(stitch, READ_SCHEMA))


_SPLIT_NAMES = [*_NAMES, "block", "head", "tail", "starts"]
_SPLIT_KINDS = [*_KINDS, pa.int64(), pa.binary(), pa.binary(), pa.bool_()]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, Iterator[pa.Array]]]:
    """(file, block, whether it reaches the file's end, its values) of each run of rows; each
    run's values must be taken before the next run is asked for."""
    todo: list[tuple[str, int, bool, int, pa.Array]] = []

    def pull() -> bool:
        while not todo:
            b = next(batches, None)
            if b is None:
                return False
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy()
            file = b.column("file").dictionary_encode()
            code = file.indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1, [len(block)]])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                size = b.column("size")[a].as_py()
                todo.append((b.column("file")[a].as_py(), int(block[a]), b.column("end")[a].as_py() >= size, size, b.column("value").slice(a, z - a)))
        return True

    while pull():
        key = todo[0][:2]
        last = todo[0][2]

        def values(key=key) -> Iterator[pa.Array]:
            while pull() and todo[0][:2] == key:
                yield todo.pop(0)[4]

        run = values()
        yield (*key, last, run)
        for _ in run:  # what the reader left
            pass


def _with_zeros(values: Iterator[pa.Array], last: bool) -> Iterator[bytes]:
    """The bytes of a split: a zero behind each value. Behind a file's last value there may
    be none; a member ends at its trailer, so one too many is taken for what it is."""
    for column in values:
        data, off = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.zeros(int(off[-1] - off[0]) + len(column), np.uint8)
        at = np.ones(len(out), bool)
        at[np.cumsum(np.diff(off) + 1) - 1] = False
        out[at] = raw[off[0] : off[-1]]
        yield out.tobytes()
