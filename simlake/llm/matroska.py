"""Matroska files as packet tables.

An EBML element is an identifier and a size, both integers of variable length, and its data. The parser walks a file's segment once: tracks, clusters
with their simple blocks and block groups, frames of laced blocks (Xiph, EBML and fixed-size lacing), and cues. Each frame is
a row with its track, its time in nanoseconds and the range of its bytes in the file, so that payloads can be read without parsing again.

Elements of unknown size end where an element of their parent's level begins. A frame in a lace follows the frame before by the
track's default duration, or by its share of the block's duration; without either all have the block's time. A packet is a cue if a cue point
names its track, cluster and time.

Defined cases: null and empty contents have no packets; a file that is cut short or malformed gives the packets before the fault, each with
the fault in `error`, and a file with a fault but no packet gives one row without a track; unknown elements are skipped; a packet of an unlisted track has no codec; repeated files are each parsed.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npwords as W
from .tables import with_text

SEGMENT, INFO, SCALE, TRACKS, ENTRY, CLUSTER, CUES, CUE_POINT = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
NUMBER, KIND, CODEC, DURATION, TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xD7, 0x83, 0x86, 0x23E383, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, EBML = 0xB3, 0xB7, 0xF7, 0xF1, 0x1A45DFA3
TOP = {SEGMENT, EBML}
#: Children of a segment: any of them ends a cluster of unknown size.
LEVEL1 = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")
PACKETS = "file_id bigint, track bigint, track_type bigint, codec string, cluster int, block int, frame int, time_ns bigint, duration_ns bigint, keyframe boolean, lacing string, byte_start bigint, byte_end bigint, is_cue boolean, error string"


class Fault(ValueError):
    pass


def vint(b: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, next place, number of bytes of the variable-length integer at a place."""
    if at >= end or not (first := b[at]):
        raise Fault(f"no integer at byte {at}")
    n = 9 - first.bit_length()
    if at + n > end:
        raise Fault(f"integer cut short at byte {at}")
    v = int.from_bytes(b[at : at + n], "big")
    return (v if keep_marker else v & ~(1 << 7 * n)), at + n, n


def element(b: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Identifier, start and end of the data of the element at a place; end is -1 where the size is unknown."""
    ident, at, n = vint(b, at, end, True)
    if n > 4:
        raise Fault(f"identifier of {n} bytes at byte {at - n}")
    size, at, n = vint(b, at, end, False)
    if size == (1 << 7 * n) - 1:
        return ident, at, -1
    return ident, at, at + size


def number(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def frame_sizes(b: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first starts."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise Fault(f"lace cut short at byte {at}")
    n, at = b[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Fault(f"fixed lace of unequal frames at byte {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Fault(f"lace cut short at byte {at}")
                size, at = size + b[at], at + 1
                if b[at - 1] != 255:
                    break
        else:
            v, at, w = vint(b, at, end, False)
            size = v if i == 0 else sizes[-1] + v - ((1 << 7 * w - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Fault(f"lace longer than its block at byte {at}")
    return [*sizes, last], at


class File:
    """A parsed file: tracks by number, cue points as (track, cluster's place in the segment, time in ticks), frames, and the fault."""

    def __init__(self, b: bytes):
        self.b, self.scale, self.tracks, self.cues, self.frames, self.error = b, 1_000_000, {}, set(), [], None
        self.clusters = self.blocks = 0
        try:
            self._top()
        except Fault as e:
            self.error = str(e)

    def _children(self, a: int, z: int):
        """(identifier, start, end, place) of the elements between, whose sizes are known."""
        while a < z:
            ident, s, e = element(self.b, a, z)
            if e < 0 or e > z:
                raise Fault(f"element cut short at byte {a}")
            yield ident, s, e, a
            a = e

    def _top(self) -> None:
        b, at = self.b, 0
        while at < len(b):
            ident, s, e = element(b, at, len(b))
            short, open_end = e > len(b), e < 0
            e = len(b) if open_end or short else e
            if ident == SEGMENT:
                e = self._segment(s, e, open_end)
            if short:
                raise Fault(f"element cut short at byte {at}")
            at = e

    def _segment(self, a: int, z: int, open_end: bool) -> int:
        """Reads a segment and returns where it ends: one of unknown size where the next file begins."""
        at, whole = a, not open_end
        while at < z:
            ident, s, e = element(self.b, at, z)
            if not whole and ident in TOP:
                return at
            short, open_end = e > z, e < 0
            e = z if short or open_end else e
            if ident == CLUSTER:
                e = self._cluster(s, e, at - a, open_end)
            elif open_end:
                raise Fault(f"unknown size at byte {at}")
            elif ident == INFO:
                for i, x, y, _ in self._children(s, e):
                    if i == SCALE:
                        self.scale = number(self.b, x, y)
            elif ident == TRACKS:
                for i, x, y, _ in self._children(s, e):
                    if i == ENTRY:
                        self._track(x, y)
            elif ident == CUES:
                for i, x, y, _ in self._children(s, e):
                    if i == CUE_POINT:
                        self._cue(x, y)
            if short:
                raise Fault(f"element cut short at byte {at}")
            at = e
        return at

    def _track(self, a: int, z: int) -> None:
        t: dict = {}
        for i, x, y, _ in self._children(a, z):
            if i in (NUMBER, KIND, DURATION):
                t[i] = number(self.b, x, y)
            elif i == CODEC:
                t[i] = self.b[x:y].rstrip(b"\0").decode("ascii", "replace")
        self.tracks[t.get(NUMBER, 0)] = (t.get(KIND), t.get(CODEC), t.get(DURATION))

    def _cue(self, a: int, z: int) -> None:
        time, places = 0, []
        for i, x, y, _ in self._children(a, z):
            if i == CUE_TIME:
                time = number(self.b, x, y)
            elif i == CUE_POSITIONS:
                p: dict = {}
                for j, s, e, _ in self._children(x, y):
                    p[j] = number(self.b, s, e)
                places.append(p)
        self.cues |= {(p.get(CUE_TRACK), p.get(CUE_CLUSTER), time) for p in places}

    def _cluster(self, a: int, z: int, place: int, open_end: bool) -> int:
        """Reads a cluster and returns where it ends."""
        at, time, k = a, 0, self.clusters
        self.clusters += 1
        b = self.b
        while at < z:
            ident, s, e = element(b, at, z)
            if open_end and (ident in LEVEL1 or ident in TOP):
                return at
            if e < 0 or e > z:
                raise Fault(f"element cut short at byte {at}")
            if ident == TIME:
                time = number(b, s, e)
            elif ident == SIMPLE:
                self._block(s, e, k, place, time, None, None)
            elif ident == GROUP:
                block, duration, key = None, None, True
                for i, x, y, _ in self._children(s, e):
                    if i == BLOCK:
                        block = (x, y)
                    elif i == BLOCK_DURATION:
                        duration = number(b, x, y)
                    elif i == REFERENCE:
                        key = False
                if block:
                    self._block(*block, k, place, time, duration, key)
            at = e
        return at

    def _block(self, a: int, z: int, cluster: int, place: int, base: int, duration: int | None, key: bool | None) -> None:
        track, at, _ = vint(self.b, a, z, False)
        if at + 3 > z:
            raise Fault(f"block cut short at byte {a}")
        ticks = base + struct.unpack_from(">h", self.b, at)[0]
        flags = self.b[at + 2]
        sizes, at = frame_sizes(self.b, at + 3, z, flags >> 1 & 3)
        each = self.tracks.get(track, (None, None, None))[2]
        if each is None and duration is not None:
            each = duration * self.scale // len(sizes)
        for i, n in enumerate(sizes):
            self.frames.append((track, cluster, self.blocks, i, ticks * self.scale + i * (each or 0), each, bool(flags & 0x80) if key is None else key, LACINGS[flags >> 1 & 3], at, at + n, (place, ticks)))
            at += n
        self.blocks += 1


def packets(files: DataFrame, content: str = "content", file_id: str = "file_id") -> DataFrame:
    """A row for each frame of each file; files has an id and the bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    def each(batches):
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                f = File(x.as_py() or b"")
                for t, c, k, j, ns, d, key, lace, a, z, (place, ticks) in f.frames:
                    kind, codec, _ = f.tracks.get(t, (None, None, None))
                    rows.append((i, t, kind, codec, c, k, j, ns, d, key, lace, a, z, (t, place, ticks) in f.cues, f.error))
                if f.error and not f.frames:
                    rows.append((i, *[None] * 13, f.error))
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return files.select(F.col(f"`{file_id}`").cast("bigint").alias("file_id"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(each, PACKETS)


def size_vint(n: int, width: int = 0) -> bytes:
    w = width or max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * w).to_bytes(w, "big")


def tag(ident: int, data: bytes, unknown: bool = False) -> bytes:
    return ident.to_bytes(-(-ident.bit_length() // 8), "big") + (b"\xff" if unknown else size_vint(len(data))) + data


def uint(ident: int, n: int) -> bytes:
    return tag(ident, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    head = b"" if kind == 0 else bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        for i, n in enumerate(sizes[:-1]):
            if i == 0:
                head += size_vint(n)
            else:
                d, w = n - sizes[i - 1], 1
                while not -((1 << 7 * w - 1) - 1) <= d <= (1 << 7 * w - 1) - 1:
                    w += 1
                head += size_vint(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def mux(blocks: list[tuple[int, int, list[bytes]]], tracks: dict[int, tuple[int, str, int | None]], per_cluster: int = 16, unknown: bool = False) -> bytes:
    """A file of (track, time in ticks, frames) blocks. Laces alternate between the kinds that their frames allow; every other block is in a group."""
    entries = b"".join(tag(ENTRY, uint(NUMBER, t) + uint(KIND, k) + tag(CODEC, c.encode()) + (uint(DURATION, d) if d else b"")) for t, (k, c, d) in tracks.items())
    body = tag(INFO, uint(SCALE, 1_000_000)) + tag(TRACKS, entries)
    cues = b""
    for i in range(0, len(blocks), per_cluster):
        base = blocks[i][1]
        place = len(body)
        data = uint(TIME, base)
        for k, (t, time, frames) in enumerate(blocks[i : i + per_cluster]):
            equal = len({len(x) for x in frames}) == 1
            kind = 0 if len(frames) == 1 else (2 if equal and k % 2 else (1, 3)[k % 2])
            payload = size_vint(t) + struct.pack(">h", time - base) + bytes([kind << 1 | (0x80 if k % 2 == 0 else 0)]) + lace(frames, kind)
            data += tag(SIMPLE, payload) if k % 2 == 0 else tag(GROUP, tag(BLOCK, payload) + uint(BLOCK_DURATION, 10 * len(frames)))
            if k == 0:
                cues += tag(CUE_POINT, uint(CUE_TIME, time) + tag(CUE_POSITIONS, uint(CUE_TRACK, t) + uint(CUE_CLUSTER, place)))
        body += tag(CLUSTER, data, unknown)
    return tag(EBML, uint(0x4286, 1) + tag(0x4282, b"matroska")) + tag(SEGMENT, body + (tag(CUES, cues) if cues else b""), unknown)


def subtitle_files(docs: DataFrame) -> DataFrame:
    """(file_id, content): each document as a file of subtitles, which stands in for a media column. Lines go by twos and threes into laced
    blocks of two tracks, a tenth of a second apart; every third file leaves the sizes of its segment and clusters open."""

    def each(batches):
        for b in batches:
            out: list[bytes | None] = []
            size = 0
            first = 0
            ids = b.column(0)
            for i, t in zip(ids.to_pylist(), W.texts(b.column(1))):
                lines = [x for x in t.as_py().encode().split(b"\n") if x]
                blocks, at, k = [], 0, 0
                while at < len(lines):
                    n = 1 + (k + (i or 0)) % 3
                    blocks.append((1 + k % 2, 100 * k, lines[at : at + n]))
                    at += n
                    k += 1
                out.append(mux(blocks, {1: (17, "S_TEXT/UTF8", None), 2: (17, "S_TEXT/UTF8", 50_000_000)}, unknown=(i or 0) % 3 == 0))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array(out, pa.binary())], ["file_id", "content"])
                    first, out, size = first + len(out), [], 0
            if out:
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array(out, pa.binary())], ["file_id", "content"])

    own = with_text(docs, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(each, "file_id bigint, content binary")
