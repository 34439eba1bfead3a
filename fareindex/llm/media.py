"""ISO media containers as table columns.

`wrap_samples` writes a byte string as a one-track ISO base media file of raw
8-bit frames; `parse_media` walks the nested boxes of any such file, decodes its
sample tables and reports codec, duration and the byte ranges of keyframes. The
payload itself is never decoded, only located.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from fareindex.llm.common import free_name, map_texts

FRAME = 64  # bytes: one 8 x 8 frame of 8-bit grey samples
FRAMES_PER_CHUNK = 256
KEYFRAME_EVERY = 32
TIMESCALE = 25_000
FRAME_TICKS = 1_000
MAX_DEPTH = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def _table(values) -> bytes:
    return np.asarray(values, dtype=">u4").tobytes()


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of FRAME."""
    return payload + b"\0" * (-len(payload) % FRAME if payload else FRAME)


def wrap_samples(payload: bytes) -> bytes:
    """An ISO media file whose frames are `payload`, a positive multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    ticks = n * FRAME_TICKS
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), struct.pack(">II", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, FRAMES_PER_CHUNK, 1)] if n >= FRAMES_PER_CHUNK else []
    if n % FRAMES_PER_CHUNK:
        runs.append((chunks, n % FRAMES_PER_CHUNK, 1))
    keys = np.arange(1, n + 1, KEYFRAME_EVERY)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
            _full(b"stss", struct.pack(">I", len(keys)), _table(keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), _table(runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), (first + np.arange(chunks, dtype=np.uint64) * (FRAMES_PER_CHUNK * FRAME)).astype(">u8").tobytes()),
        )
        minf = _box(b"minf", _box(b"vmhd", struct.pack(">I", 1), bytes(8)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, min(ticks, 0xFFFFFFFF), 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\3", struct.pack(">IIIII", 0, 0, 1, 0, min(ticks, 0xFFFFFFFF)), bytes(16), unity, struct.pack(">II", 8 << 16, 8 << 16))
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, min(ticks, 0xFFFFFFFF)), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(head) + len(moov(0)) + lead
    return head + moov(first) + _box(b"mdat", payload)


def walk(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple = ()):
    """(path, body start, body end) of each box, outer boxes first.

    32- and 64-bit sizes and size 0 (to the end) are understood. Walking stops
    at a header that does not fit its parent.
    """
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        start = lo + 8
        if size == 1:
            if lo + 16 > hi:
                return
            size, start = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end < start or end > hi:
            return
        yield (*path, kind), start, end
        if kind in CONTAINERS and len(path) < MAX_DEPTH:
            yield from walk(data, start, end, (*path, kind))
        lo = end


def _words(data, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, dtype=kind, count=count, offset=at).astype(np.int64)


def _sample_table(data: memoryview, boxes: dict) -> dict:
    """Offsets, sizes, duration and keyframes of one track."""
    at, _ = boxes[b"stsz"] if b"stsz" in boxes else boxes[b"stz2"]
    if b"stsz" in boxes:
        fixed, n = struct.unpack_from(">II", data, at + 4)
        if n * max(fixed, 1) > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(n, fixed, np.int64) if fixed else _words(data, at + 12, n)
    else:
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, -(-n // 2), at + 12)
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        else:
            sizes = _words(data, at + 12, n, ">u2" if bits == 16 else ">u1")
    wide = b"co64" in boxes
    at, _ = boxes[b"co64"] if wide else boxes[b"stco"]
    chunks = _words(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8" if wide else ">u4")
    at, _ = boxes[b"stsc"]
    runs = _words(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
    last = np.append(runs[1:, 0], len(chunks) + 1)
    if n and (not len(runs) or runs[0, 0] != 1):
        raise ValueError("the first chunk has no run")
    if len(runs) and (runs[:, 1].min() < 0 or runs[:, 1].max() > n or (last < runs[:, 0]).any()):
        raise ValueError("chunk runs out of order or beyond the samples")
    per_chunk = np.repeat(runs[:, 1], last - runs[:, 0])
    if per_chunk.sum() < n:
        raise ValueError("samples without a chunk")
    per_chunk = per_chunk[: np.searchsorted(np.cumsum(per_chunk), n) + 1]  # later chunks hold none
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(per_chunk)])[:-1]
    offsets = chunks[: len(per_chunk)][chunk_of] + before - before[np.minimum(first, max(n - 1, 0))][chunk_of]
    at, _ = boxes[b"stts"]
    times = _words(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
    if b"stss" in boxes:
        at, _ = boxes[b"stss"]
        keys = _words(data, at + 8, struct.unpack_from(">I", data, at + 4)[0]) - 1
    else:  # without the table every sample is one
        keys = np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("keyframes beyond the samples")
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples beyond the file")
    return {"offsets": offsets, "sizes": sizes, "ticks": int((times[:, 0] * times[:, 1]).sum()), "keys": keys}


def _fragment(data: memoryview, moof: int, boxes: dict, extends: dict, at: int) -> tuple[int, np.ndarray, np.ndarray, int, np.ndarray]:
    """One track run: (track, offsets, sizes, ticks, keyframes) of its samples. `at`: where data goes on if the run gives no offset."""
    lo, _ = boxes[b"tfhd"]
    flags, track = struct.unpack_from(">II", data, lo)
    flags &= 0xFFFFFF
    fields, p = {}, lo + 8
    for bit, form in ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")):
        if flags & bit:
            fields[bit] = struct.unpack_from(form, data, p)[0]
            p += struct.calcsize(form)
    ticks, size, mark = (fields.get(bit, default) for bit, default in zip((8, 16, 32), extends.get(track, (0, 0, 0))))
    start = fields.get(1, moof if flags & 0x20000 else at)
    lo, hi = boxes[b"trun"]
    flags, n = struct.unpack_from(">II", data, lo)
    p = lo + 8
    if flags & 1:
        start = fields.get(1, moof) + struct.unpack_from(">i", data, p)[0]
        p += 4
    first = None
    if flags & 4:
        first, p = struct.unpack_from(">I", data, p)[0], p + 4
    names = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if p + 4 * n * len(names) > hi or not names and n * max(size, 1) > len(data):
        raise ValueError("more samples than bytes")
    rows = _words(data, p, n * len(names)).reshape(n, len(names))
    column = lambda bit, default: rows[:, names.index(bit)] if bit in names else np.full(n, default, np.int64)
    sizes, marks = column(0x200, size), column(0x400, mark).copy()
    if first is not None and n:
        marks[0] = first
    offsets = start + np.cumsum(sizes) - sizes
    if n and (offsets[0] < 0 or offsets[-1] + sizes[-1] > len(data)):
        raise ValueError("samples beyond the file")
    return track, offsets, sizes, int(column(0x100, ticks).sum()), np.flatnonzero(marks & 0x10000 == 0)  # sync unless marked otherwise


def _read_fragments(data: memoryview, tracks: dict[int, dict], extends: dict) -> str | None:
    """Adds the samples of each movie fragment to its track; the first thing that went wrong."""
    error = None
    for path, start, end in walk(data):
        if path != (b"moof",):
            continue
        moof, at = start - 8, start - 8
        found: list[dict] = []
        for inner, lo, hi in walk(data, start, end, path):
            if inner == (b"moof", b"traf"):
                found.append({})
            elif inner == (b"moof", b"traf", b"trun") and found:
                found.append({k: v for k, v in found[-1].items() if k == b"tfhd"} | {b"trun": (lo, hi)})
            elif found and inner[:2] == (b"moof", b"traf"):
                found[-1].setdefault(inner[-1], (lo, hi))
        for boxes in found:
            if b"trun" not in boxes:
                continue
            try:
                track, offsets, sizes, ticks, keys = _fragment(data, moof, boxes, extends, at)
                table = tracks[track]
            except (KeyError, IndexError, ValueError, OverflowError, struct.error) as e:
                error = error or f"fragment: {type(e).__name__}"
                continue
            table["keys"] = np.append(table["keys"], keys + len(table["sizes"]))
            table["offsets"], table["sizes"] = np.append(table["offsets"], offsets), np.append(table["sizes"], sizes)
            table["ticks"] += ticks
            at = int(offsets[-1] + sizes[-1]) if len(offsets) else at
    return error


def parse_media(media: bytes | None) -> dict:
    """brand, and per track: codec, handler, timescale, ticks, samples, key ranges; samples of movie fragments follow those of the track.

    Null or unreadable bytes give `error` and no tracks; a track or fragment with
    a broken table is skipped and named in `error`.
    """
    out: dict = {"brand": None, "tracks": [], "error": None}
    if not media:
        return out | {"error": "empty"}
    data = memoryview(media)
    tracks: list[dict] = []
    extends: dict[int, tuple] = {}  # defaults of fragments: ticks, size and flags of a sample
    for path, lo, hi in walk(data):
        if path[-1] == b"ftyp" and hi - lo >= 4:
            out["brand"] = bytes(data[lo : lo + 4]).decode("latin-1")
        elif path == (b"moov", b"trak"):
            tracks.append({})
        elif path == (b"moov", b"mvex", b"trex") and hi - lo >= 24:
            track, _, *defaults = struct.unpack_from(">5I", data, lo + 4)
            extends[track] = tuple(defaults)
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (lo, hi))
    if not tracks:
        return out | {"error": "no track"}
    by_id: dict[int, dict] = {}
    for boxes in tracks:
        try:
            at, _ = boxes[b"mdhd"]
            timescale = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            at, end = boxes[b"stsd"]
            codec = bytes(data[at + 12 : at + 16]).decode("latin-1") if end - at >= 16 else ""
            handler = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in boxes else ""
            table = {"codec": codec.strip(), "handler": handler, "timescale": timescale} | _sample_table(data, boxes)
            if b"tkhd" in boxes:
                at, _ = boxes[b"tkhd"]
                by_id[struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]] = table
        except (KeyError, IndexError, ValueError, OverflowError, struct.error) as e:
            out["error"] = f"track: {type(e).__name__}"
            continue
        out["tracks"].append(table)
    out["error"] = out["error"] or _read_fragments(data, by_id, extends)
    for table in out["tracks"]:
        keys = table["keys"]
        table["ranges"] = np.stack([table["offsets"][keys], table["offsets"][keys] + table["sizes"][keys]], 1)
    return out


def read_samples(media: bytes, track: dict) -> bytes:
    """The stored bytes of a track in sample order; neighbouring ranges are read at once."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, stops = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(offsets)]]) - 1
    return b"".join(media[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(starts, stops))


def describe(media: bytes | None) -> str:
    """One line: brand, then codec, frames, seconds and keyframe byte ranges of each track."""
    found = parse_media(media)
    lines = [found["brand"] or "-"]
    for t in found["tracks"]:
        seconds = t["ticks"] / t["timescale"] if t["timescale"] else 0.0
        spans = hashlib.sha256(t["ranges"].astype(">i8").tobytes()).hexdigest()[:16]
        lines.append(f"{t['codec']}:{t['handler']}:samples={len(t['sizes'])}:seconds={seconds:.3f}:keyframes={len(t['keys'])}:ranges={spans}")
    return "|".join([*lines, *([f"error={found['error']}"] if found["error"] else [])])


MEDIA_COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_ms long, keyframes array<struct<start:long,end:long>>"
)


def _media_row(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = wrap_samples(pad(raw))
    track = parse_media(media)["tracks"][0]
    stored = read_samples(media, track)
    keys = [{"start": a, "end": b} for a, b in track["ranges"].tolist()]
    return (
        len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-FRAME:]), len(media),
        hashlib.sha256(media).hexdigest(), describe(media), track["codec"], 1000 * track["ticks"] // track["timescale"], keys,
    )


def media_digest(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Each text stored as an ISO media file, read back and described.

    A null text is the empty one; the empty text is one zero frame; a text of any
    length is one file, built and read in the memory of one task. Rows are
    independent: repeated rows give repeated results, an empty table an empty one.
    `keep` must not hold the names of the new columns.
    """
    names = [f.split()[0] for f in MEDIA_COLUMNS.split(", ")]

    def start():
        return lambda texts: dict(zip(names, map(list, zip(*map(_media_row, texts)))))

    return map_texts(docs, start, MEDIA_COLUMNS, keep)


def media_features(files: DataFrame, content: str = "content", name: str = "media") -> DataFrame:
    """`files` with `name`, a string: the description of each binary `content`; null, empty and broken ones name their error.

    Where `files` has such a column already, the new one's name is lengthened.
    """
    name = free_name(files, name)
    return map_texts(files, lambda: lambda blobs: {name: [describe(b) for b in blobs]}, f"`{name}` string", None, content)
