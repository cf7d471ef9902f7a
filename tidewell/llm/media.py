"""Media columns: ISO media files as binary cells, and what their boxes say.

write_media() stores bytes as unsigned 8-bit samples of one raw audio track. read_media() walks nested boxes of any ISO media
file and decodes the sample tables of its tracks into codec, duration and the byte ranges of key frames; sample data is never
decoded, only handed back as it is stored. Files whose samples lie in fragments have an error that says so.

Null and empty inputs are stored as 64 zero bytes. A broken file gives nulls and the column error, never a crash. One row in,
one row out, without a shuffle; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, documents, slices

UNIT = 64  # samples of a frame, which is what the sample table counts
PER_CHUNK = 16
KEY_EVERY = 32
RATE = 8000
#: Boxes that hold boxes (fixed values).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def container(payload: bytes) -> bytes:
    """An ISO media file of one raw audio track; payload is a multiple of UNIT."""
    frames = len(payload) // UNIT
    packs = -(-frames // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if frames % PER_CHUNK == 0 else ([(1, PER_CHUNK)] if packs > 1 else []) + [(packs, frames % PER_CHUNK)]
    keys = np.arange(1, frames + 1, KEY_EVERY).astype(">u4")
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, frames)),
            full(b"stco", struct.pack(">I", packs), (first + np.arange(packs, dtype=np.int64) * UNIT * PER_CHUNK).astype(">u4").tobytes()),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        length = frames * UNIT
        inner = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), inner)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, length, 0, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    first = len(kind) + len(moov(0)) + 8
    return kind + moov(first) + box(b"mdat", payload)


def boxes(data: bytes, at: int, end: int):
    """(path's last kind, first byte, end) of each box between at and end, parents first; payload boxes aren't entered."""
    stack = [(at, end, ())]
    while stack:
        at, end, above = stack.pop()
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise ValueError(f"box {kind!r} at {at} leaves its parent")
            yield (*above, kind), at + head, at + size
            if kind in NESTED:
                stack.append((at + size, end, above))
                at, end, above = at + head, at + size, (*above, kind)
                continue
            at += size


def numbers(data: bytes, at: int, end: int, columns: int, kind: str = ">u4", skip: int = 8) -> np.ndarray:
    """The entries of a full box that counts its entries."""
    n = struct.unpack_from(">I", data, at + skip - 4)[0]
    out = np.frombuffer(data, kind, min(n, max(0, end - at - skip) // (4 * columns)) * columns, at + skip).astype(np.int64)
    return out.reshape(-1, columns)


def tracks(data: bytes) -> list[dict]:
    """The tables of each track."""
    found: list[dict] = []
    for path, at, end in boxes(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            found.append({"codec": None, "scale": None, "duration": None, "key": None})
        if not found or b"trak" not in path:
            continue
        own = found[-1]
        if kind == b"mdhd":
            wide = data[at] == 1
            own["scale"], own["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr":
            own["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd" and end >= at + 16:
            own["codec"] = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind == b"stsc":
            own["runs"] = numbers(data, at, end, 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if same and n * same > len(data):
                raise ValueError("the samples are larger than the file")
            own["sizes"] = np.full(n, same, np.int64) if same else numbers(data, at, end, 1, skip=12)[:, 0]
        elif kind == b"stco":
            own["chunks"] = numbers(data, at, end, 1)[:, 0]
        elif kind == b"co64":
            wide = np.frombuffer(data, ">u8", min(struct.unpack_from(">I", data, at + 4)[0], (end - at - 8) // 8), at + 8)
            own["chunks"] = np.minimum(wide, len(data) + 1).astype(np.int64)
        elif kind == b"stss":
            own["key"] = numbers(data, at, end, 1)[:, 0] - 1
    return found


def samples(track: dict) -> tuple[np.ndarray, np.ndarray]:
    """First byte and size of each sample of a track, from its tables alone."""
    sizes, packs, runs = track.get("sizes"), track.get("chunks"), track.get("runs")
    if sizes is None or packs is None or runs is None:
        raise ValueError("a track lacks sample tables")
    spans = np.diff(np.append(runs[:, 0], len(packs) + 1))
    if len(runs) and (runs[0, 0] != 1 or spans.min() < 0 or int((spans * runs[:, 1]).sum()) > len(sizes)):
        raise ValueError("the chunks don't fit the samples")
    own = np.repeat(np.arange(len(packs)), np.repeat(runs[:, 1], spans))
    if len(own) < len(sizes):
        raise ValueError("the chunks hold fewer samples than there are")
    before = np.cumsum(sizes) - sizes
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return packs[own] + before - np.maximum.accumulate(np.where(new, before, 0)), sizes


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text's UTF-8) and media, the stored file."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, 1):
                raw = [x or b"" for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([container(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


TRACK = "codec:string,handler:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<first:bigint,end:bigint>>"
FOUND = f"codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<first:bigint,end:bigint>>, tracks array<struct<{TRACK}>>, payload binary, error string"


def described(track: dict, length: int, fragmented: bool) -> tuple[dict, np.ndarray, np.ndarray]:
    """(what a track's tables say, first byte and size of its samples)."""
    first, size = samples(track)
    if not len(first) and fragmented:
        raise ValueError("fragmented file")
    if len(first) and (first.min() < 0 or (first + size).max() > length):
        raise ValueError("samples lie outside the file")
    key = np.arange(len(first)) if track["key"] is None else track["key"][(track["key"] >= 0) & (track["key"] < len(first))]
    ranges = [{"first": a, "end": b} for a, b in zip(first[key].tolist(), (first + size)[key].tolist(), strict=True)]
    return {"codec": track["codec"], "handler": track.get("handler"), "timescale": track["scale"], "duration": track["duration"], "n_samples": len(first), "keyframes": ranges}, first, size


def probe(data: bytes | None) -> tuple:
    """The fields of FOUND: the first track's, and those of all tracks in tracks. A broken track makes the whole file an error."""
    try:
        if not data or not (every := tracks(data)):
            raise ValueError("no track")
        fragmented = any(path[-1] == b"moof" for path, _, _ in boxes(data, 0, len(data)))
        found = [described(t, len(data), fragmented) for t in every]
        own, first, size = found[0]
        new = np.ones(len(first), bool)
        new[1:] = first[1:] != (first + size)[:-1]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], len(first)) - 1
        payload = b"".join(data[first[a] : first[b] + size[b]] for a, b in zip(runs.tolist(), ends.tolist(), strict=True))
        return own["codec"], own["timescale"], own["duration"], own["n_samples"], own["keyframes"], [t for t, _, _ in found], payload, None
    except (ValueError, OverflowError, struct.error, IndexError) as e:
        return None, None, None, None, None, None, None, str(e)[:200]


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df and the fields of FOUND for each file: what its tables say, and the bytes of its samples as they are stored. Columns of df with those names are replaced."""
    from pyspark.sql import types as T

    more = T._parse_datatype_string(FOUND)

    def run(batches):
        import pyarrow as pa

        pair = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(media_col)).to_pylist()
            for a, b in chunks([len(x or b"") for x in data], 8 << 20):
                found = list(zip(*map(probe, data[a:b]), strict=True))
                track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pair))])
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pair), pa.list_(track), pa.binary(), pa.string()]
                own = [pa.array(x, t) for x, t in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *own], [*batch.schema.names, *more.names])

    clash = set(more.names) & set(df.columns)
    return df.drop(*clash).mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name not in clash] + more.fields))


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    read = read_media(write_media(documents(spark, sf_dir)))
    last = F.element_at("keyframes", -1)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.concat(F.lit("codec="), "codec"), F.concat(F.lit("duration="), "duration", F.lit("/"), "timescale"), F.concat(F.lit("samples="), "n_samples"),
            F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("last="), last["first"], F.lit("-"), last["end"]),
        ).alias("feature"),
    )
