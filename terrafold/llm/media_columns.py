"""Media columns: ISO media containers (MP4, MOV, fragmented MP4) read by their boxes and sample tables alone.

The boxes are walked, never the payload: codec, time scale, duration and the byte ranges of keyframes come from the sample
tables (stsd, stts, stsc, stsz or stz2, stco or co64, stss) and from the runs of movie fragments. Tables are decoded with
NumPy; their length is checked against the box that holds them and against the file, so a false count is an error and not
an allocation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship

# Fixed values of the format: boxes that hold boxes, and flags of fragment headers and of samples.
CONTAINERS = frozenset("moov trak mdia minf stbl mvex moof traf".split())
TFHD_BASE, TFHD_DESCRIPTION, TFHD_DURATION, TFHD_SIZE, TFHD_FLAGS, TFHD_MOOF_BASE = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TRUN_OFFSET, TRUN_FIRST, TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000
#: Boxes may nest so deep.
DEPTH = 16
#: The payload format of encode(): bytes of a sample, samples of a chunk (the first is a keyframe), samples per second.
SAMPLE, CHUNK_SAMPLES, RATE = 192, 64, 8000
SCHEMA = "track_id long, kind string, codec string, timescale long, duration double, width int, height int, n_samples long, keyframes array<struct<start:long,end:long,time:double>>, error string"


class BadMedia(ValueError):
    """What a container says of itself does not hold."""


@dataclass
class Track:
    id: int = 0
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    units: int = 0
    width: int = 0
    height: int = 0
    tables: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: One entry per stretch of samples: offsets, sizes, durations in units, sync flags.
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, start of the box, start of its body, its end) of the boxes side by side in data[start:end]."""
    while start < end:
        if end - start < 8:
            if start and not any(data[start:end]):
                return  # padding
            raise BadMedia("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise BadMedia("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise BadMedia(f"box {kind.decode('latin-1')} ends outside its parent")
        yield kind.decode("latin-1"), start, body, stop
        start = stop


def _numbers(data: memoryview, kind: str, at: int, end: int, count: int, form: str) -> np.ndarray:
    form = np.dtype(form)
    if count * form.itemsize > end - at:
        raise BadMedia(f"table {kind} is longer than its box")
    return np.frombuffer(data, form, count, at)


def _u(data: memoryview, form: str, at: int, end: int) -> tuple:
    if struct.calcsize(form) > end - at:
        raise BadMedia("a header is cut off")
    return struct.unpack_from(form, data, at)


def _sample_sizes(data: memoryview, track: Track) -> np.ndarray:
    if "stz2" in track.tables:
        at, end = track.tables["stz2"]
        bits, n = _u(data, ">4x3xBI", at, end)
        if bits not in (4, 8, 16):
            raise BadMedia("stz2 has no such field size")
        if bits == 4:
            pairs = _numbers(data, "stz2", at + 12, end, (n + 1) // 2, "u1")
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
        return _numbers(data, "stz2", at + 12, end, n, f">u{bits // 8}").astype(np.int64)
    if "stsz" not in track.tables:
        return np.zeros(0, np.int64)
    at, end = track.tables["stsz"]
    size, n = _u(data, ">4xII", at, end)
    if size and size * n > len(data):
        raise BadMedia("the samples are longer than the file")
    return np.full(n, size, np.int64) if size else _numbers(data, "stsz", at + 12, end, n, ">u4").astype(np.int64)


def _spread(values: np.ndarray, counts: np.ndarray, n: int, kind: str) -> np.ndarray:
    """Each value so often; in all n times."""
    if int(counts.sum()) != n:
        raise BadMedia(f"table {kind} does not count the samples")
    return np.repeat(values, counts)


def _from_tables(data: memoryview, track: Track) -> None:
    """The run of samples that a track's sample table describes."""
    sizes = _sample_sizes(data, track)
    n = len(sizes)
    if not n:
        return

    def table(kind: str, form: str, columns: int = 1) -> np.ndarray:
        if kind not in track.tables:
            raise BadMedia(f"there is no {kind}")
        at, end = track.tables[kind]
        count = _u(data, ">4xI", at, end)[0]
        return _numbers(data, kind, at + 8, end, count * columns, form).astype(np.int64).reshape(count, columns)

    stts = table("stts", ">u4", 2)
    durations = _spread(stts[:, 1], stts[:, 0], n, "stts")
    chunks = (table("co64", ">u8") if "co64" in track.tables else table("stco", ">u4"))[:, 0]
    stsc = table("stsc", ">u4", 3)
    if not len(stsc) or stsc[0, 0] != 1 or (np.diff(stsc[:, 0]) <= 0).any():
        raise BadMedia("table stsc is out of order")
    first = np.minimum(np.append(stsc[:, 0] - 1, len(chunks)), len(chunks))
    per_chunk = np.repeat(stsc[:, 1], np.diff(first))
    chunk = _spread(np.arange(len(chunks)), per_chunk, n, "stsc")
    before = np.cumsum(sizes) - sizes
    starts = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk] + before - before[np.minimum(starts, n - 1)][chunk]
    sync = np.ones(n, bool)
    if "stss" in track.tables:
        keys = table("stss", ">u4")[:, 0]
        if len(keys) and (keys.min() < 1 or keys.max() > n):
            raise BadMedia("table stss names no sample")
        sync[:] = False
        sync[keys - 1] = True
    track.runs.append((offsets, sizes, durations, sync))


class _Reader:
    def __init__(self, data: memoryview) -> None:
        self.data, self.tracks, self.extends, self.open = data, [], {}, None
        self.fragment, self.next = (0, [0, 0, 0]), 0

    def walk(self, start: int, end: int, moof: int = 0, depth: int = 0) -> None:
        if depth > DEPTH:
            raise BadMedia("boxes nest too deep")
        for kind, at, body, stop in boxes(self.data, start, end):
            if kind == "trak":
                self.open = Track()
                self.tracks.append(self.open)
            if kind == "traf":
                self.open = None
            if kind in CONTAINERS:
                self.walk(body, stop, at if kind == "moof" else moof, depth + 1)
            elif handler := getattr(self, f"_{kind}", None) if kind.isalnum() else None:
                handler(body, stop, moof)
            elif self.open and kind in ("stts", "stsc", "stsz", "stz2", "stco", "co64", "stss"):
                self.open.tables[kind] = (body, stop)
            if kind == "trak":
                _from_tables(self.data, self.open)
                self.open = None

    def _tkhd(self, at: int, end: int, moof: int) -> None:
        wide = _u(self.data, ">B", at, end)[0] == 1
        if self.open:
            self.open.id = _u(self.data, ">20xI" if wide else ">12xI", at, end)[0]
            w, h = _u(self.data, ">88xII" if wide else ">76xII", at, end)
            self.open.width, self.open.height = w >> 16, h >> 16

    def _mdhd(self, at: int, end: int, moof: int) -> None:
        if self.open:
            wide = _u(self.data, ">B", at, end)[0] == 1
            self.open.timescale, self.open.units = _u(self.data, ">20xIQ" if wide else ">12xII", at, end)

    def _hdlr(self, at: int, end: int, moof: int) -> None:
        if self.open and not self.open.kind:
            self.open.kind = _u(self.data, ">8x4s", at, end)[0].decode("latin-1")

    def _stsd(self, at: int, end: int, moof: int) -> None:
        if not self.open or not _u(self.data, ">4xI", at, end)[0]:
            return
        kind, _, body, stop = next(boxes(self.data, at + 8, end), ("", 0, 0, 0))
        self.open.codec = kind.rstrip()
        # Visual entries have 78 bytes before their own boxes; of those avcC names the profile.
        if kind in ("avc1", "avc3") and stop - body > 78:
            for inner, _, b, s in boxes(self.data, body + 78, stop):
                if inner == "avcC" and s - b >= 4:
                    self.open.codec += "." + bytes(self.data[b + 1 : b + 4]).hex()

    def _trex(self, at: int, end: int, moof: int) -> None:
        track, _, duration, size, flags = _u(self.data, ">4xIIIII", at, end)
        self.extends[track] = (duration, size, flags)

    def _tfhd(self, at: int, end: int, moof: int) -> None:
        flags, track = _u(self.data, ">II", at, end)
        flags, at = flags & 0xFFFFFF, at + 8
        self.open = next((t for t in self.tracks if t.id == track), None)
        base, defaults = moof, list(self.extends.get(track, (0, 0, 0)))
        for bit, form, slot in ((TFHD_BASE, ">Q", None), (TFHD_DESCRIPTION, ">I", -1), (TFHD_DURATION, ">I", 0), (TFHD_SIZE, ">I", 1), (TFHD_FLAGS, ">I", 2)):
            if flags & bit:
                value = _u(self.data, form, at, end)[0]
                at += struct.calcsize(form)
                if slot is None:
                    base = value
                elif slot >= 0:
                    defaults[slot] = value
        self.fragment = (base, defaults)
        self.next = base

    def _trun(self, at: int, end: int, moof: int) -> None:
        if not self.open:
            return
        flags, n = _u(self.data, ">II", at, end)
        flags, at, start = flags & 0xFFFFFF, at + 8, self.next
        base, (duration, size, common) = self.fragment
        if flags & TRUN_OFFSET:
            start, at = base + _u(self.data, ">i", at, end)[0], at + 4
        first = None
        if flags & TRUN_FIRST:
            first, at = _u(self.data, ">I", at, end)[0], at + 4
        names = [b for b in (TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_SHIFT) if flags & b]
        if not flags & TRUN_SIZE and size * n > len(self.data) or not names and n > len(self.data):
            raise BadMedia("the samples are longer than the file")
        rows = _numbers(self.data, "trun", at, end, n * len(names), ">u4").astype(np.int64).reshape(n, len(names))
        column = lambda b, default: rows[:, names.index(b)] if flags & b else np.full(n, default, np.int64)
        sizes, marks = column(TRUN_SIZE, size), column(TRUN_FLAGS, common).copy()
        if first is not None and n and not flags & TRUN_FLAGS:
            marks[0] = first
        self.next = start + int(sizes.sum())
        self.open.runs.append((start + np.cumsum(sizes) - sizes, sizes, column(TRUN_DURATION, duration), marks & NOT_SYNC == 0))


def tracks_of(data: bytes) -> list[Track]:
    """The tracks of a container; BadMedia if its boxes or tables contradict each other or the file."""
    view = memoryview(data)
    reader = _Reader(view)
    reader.walk(0, len(view))
    for t in reader.tracks:
        for offsets, sizes, _, _ in t.runs:
            if len(offsets) and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(view)):
                raise BadMedia("a sample lies outside the file")
    return reader.tracks


def keyframes(track: Track) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, seconds) of the keyframes' byte ranges; where all samples are keyframes, neighbours are one range."""
    if not track.runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    offsets, sizes, durations, sync = (np.concatenate(x) for x in zip(*track.runs, strict=True))
    times = (np.cumsum(durations) - durations) / (track.timescale or 1)
    if not sync.all():
        return offsets[sync], offsets[sync] + sizes[sync], times[sync]
    new = np.concatenate(([True], offsets[1:] != offsets[:-1] + sizes[:-1]))
    last = np.concatenate((new[1:], [True]))
    return offsets[new], (offsets + sizes)[last], times[new]


def payload(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order, joined where they lie side by side."""
    parts = []
    for offsets, sizes, _, _ in track.runs:
        cut = np.flatnonzero(np.concatenate(([True], offsets[1:] != offsets[:-1] + sizes[:-1])))
        parts += [data[a:b] for a, b in zip(offsets[cut], (offsets + sizes)[np.append(cut[1:], len(offsets)) - 1], strict=True)]
    return b"".join(parts)


def n_samples(track: Track) -> int:
    return sum(len(r[0]) for r in track.runs)


def seconds(track: Track) -> float:
    """A track's duration: its header's, or that of its samples where fragments follow and the header has none."""
    units = track.units or int(sum(int(r[2].sum()) for r in track.runs))
    return units / track.timescale if track.timescale else 0.0


def media_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """A row per input row and track, with the input's other columns and those of SCHEMA, from a binary column.

    A container without tracks gives one row of nulls; what is no container, is cut off or contradicts itself gives one
    row of nulls with an error, as null and empty content do. Payloads are not decoded; a file is held whole by the task
    that reads it, its tables by a small multiple of the number of samples. Input columns that clash with SCHEMA are
    replaced; repeated rows are handled each; an empty table gives no rows.
    """
    made = [c.split(" ")[0] for c in SCHEMA.replace("struct<start:long,end:long,time:double>", "").split(", ")]
    others = [c for c in files.columns if c != content and c not in made]
    read = files.select(*others, content)
    schema = read.drop(content).schema
    for f in files.sparkSession.createDataFrame([], SCHEMA).schema:
        schema = schema.add(f)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("time", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), ranges, pa.string()]

    def rows_of(data: bytes | None) -> list[tuple]:
        if not data:
            return [(None,) * 9 + ("no content",)]
        try:
            found = tracks_of(data)
        except (BadMedia, OverflowError) as e:
            return [(None,) * 9 + (str(e),)]
        listed = lambda t: [{"start": a, "end": b, "time": s} for a, b, s in zip(*(x.tolist() for x in keyframes(t)), strict=True)]
        return [(t.id, t.kind, t.codec, t.timescale, seconds(t), t.width, t.height, n_samples(t), listed(t), None) for t in found] or [(None,) * 10]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = rows_of(b.column(len(others))[k].as_py())
                same = pa.array([k] * len(rows), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(same) for j in range(len(others))], *cols], [*others, *made])

    return read.mapInArrow(run, schema)


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind.encode() + body


def _table(kind: str, *rows: tuple[int, ...]) -> bytes:
    return box(kind, struct.pack(">II", 0, len(rows)), b"".join(struct.pack(f">{len(r)}I", *r) for r in rows))


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box("ftyp", b"isom", struct.pack(">I", 512), b"isommp41")


def encode(content: bytes) -> bytes:
    """A container whose only track holds the content, a multiple of SAMPLE bytes, as 8-bit samples of RATE a second."""
    n = len(content) // SAMPLE
    chunks = -(-n // CHUNK_SAMPLES)
    rest = n - (chunks - 1) * CHUNK_SAMPLES
    full, ms = (1, min(n, CHUNK_SAMPLES), 1), n * SAMPLE
    entry = box("raw ", bytes(6), struct.pack(">H8xHH4xI", 1, 1, 8, RATE << 16))

    def moov(base: int) -> bytes:
        stbl = box(
            "stbl",
            box("stsd", struct.pack(">II", 0, 1), entry),
            _table("stts", (n, SAMPLE)),
            _table("stss", *[(1 + k * CHUNK_SAMPLES,) for k in range(chunks)]),
            _table("stsc", full, *([(chunks, rest, 1)] if chunks > 1 and rest < CHUNK_SAMPLES else [])),
            box("stsz", struct.pack(">III", 0, SAMPLE, n)),
            _table("stco", *[(base + k * CHUNK_SAMPLES * SAMPLE,) for k in range(chunks)]),
        )
        minf = box("minf", box("smhd", bytes(8)), box("dinf", box("dref", struct.pack(">II", 0, 1), box("url ", struct.pack(">I", 1)))), stbl)
        mdia = box("mdia", box("mdhd", struct.pack(">5IHH", 0, 0, 0, RATE, ms, 0x55C4, 0)), box("hdlr", struct.pack(">II4s12x", 0, 0, b"soun"), b"\0"), minf)
        tkhd = box("tkhd", struct.pack(">6I8xHHHH", 7, 0, 0, 1, 0, ms, 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = box("mvhd", struct.pack(">5IIH10x", 0, 0, 0, RATE, ms, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box("moov", mvhd, box("trak", tkhd, mdia))

    return FTYP + moov(len(FTYP) + len(moov(0)) + 8) + box("mdat", content)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, media): each whole text, as UTF-8 filled with spaces to a positive multiple of SAMPLE, in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                media = encode(raw.ljust(max(1, -(-len(raw) // SAMPLE)) * SAMPLE))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([len(raw)], pa.int64()), pa.array([media], pa.binary())], ["doc", "n_bytes", "media"])

    read = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    schema = read.select("doc").schema.add("n_bytes", "long").add("media", "binary")
    return read.mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """doc, n_bytes, and what a stored container says: payload_bytes, payload_sha256, tail_crc32 (of the payload's last 16
    bytes), media_bytes, media_sha256, and feature: codec, seconds, samples and keyframes' byte ranges."""
    made = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                data = b.column(2)[k].as_py()
                (track,) = tracks_of(data)
                held = payload(data, track)
                start, end, _ = keyframes(track)
                ranges = ",".join(f"{x}-{y}" for x, y in zip(start.tolist(), end.tolist(), strict=True))
                feature = f"codec={track.codec};ms={round(1000 * seconds(track))};samples={n_samples(track)};keyframes={ranges}"
                rows.append((len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string() if m.endswith("string") else pa.int64() for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc", "n_bytes", *[m.split(" ")[0] for m in made]])

    schema = media.select("doc", "n_bytes").schema
    for m in made:
        schema = schema.add(*m.split(" "))
    return media.select("doc", "n_bytes", "media").mapInArrow(run, schema)


def text_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: every whole text stored as a container in a table, read from there again by its boxes.

    Null and empty texts are 192 spaces. Null and repeated ids are rows like others; equal texts have equal values; an
    empty table gives no rows; other columns are ignored."""
    return read_back(saved(stored(docs, key, text), "media", codec="zstd"))


ship(__name__)
