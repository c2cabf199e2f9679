"""Media columns: MPEG audio (MPEG-1 Layer III) frames that carry a payload losslessly.

``wrap`` writes an ID3v2 tag, a Xing frame (frame count, byte count, seek table) and CRC-protected frames whose main
data area holds the payload; ``parse`` reads any MPEG audio stream: it skips tags, finds frame headers again after
damage, parses Xing, Info and VBRI tables, verifies checksums of Layer III frames and gives the exact duration and
frame offsets.

Defined results: null or empty text gives a payload of 64 zero bytes; equal texts give equal values; every input row
gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, shared_dir, parts, text_bytes

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer), sample rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table(poly: int = 0x8005) -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ b]
    return crc


def header(data: bytes, at: int) -> tuple | None:
    """(frame bytes, samples, sample rate, kbit/s, layer, version id, protected, mono), or None where none stands."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2 = data[at + 1], data[at + 2]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    if version == 1 or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3:
        return None
    kbps, rate = BITRATES[version == 3, layer][b2 >> 4], SAMPLE_RATES[version][b2 >> 2 & 3]
    padding = b2 >> 1 & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // rate + padding) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * kbps * 1000 // rate + padding
    return size, samples, rate, kbps, layer, version, not b1 & 1, data[at + 3] >> 6 == 3


def _side_bytes(version: int, mono: bool) -> int:
    return (17 if mono else 32) if version == 3 else (9 if mono else 17)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


# The writer's frames: version 1, layer III, protected, 48 kHz, mono: 3 bytes a kbit/s, no padding.
_RATES = BITRATES[True, 3][1:]
_OVERHEAD = 4 + 2 + 17
_ROOM = [(3 * kbps - _OVERHEAD, k + 1) for k, kbps in enumerate(_RATES)]
_FULL = _ROOM[-1][0]


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    size = 3 * _RATES[index - 1]
    return (head + crc16(head[2:] + side).to_bytes(2, "big") + side + body).ljust(size, b"\0")


def wrap(payload: bytes, tags: dict[str, str]) -> bytes:
    """An MPEG stream that carries the payload."""
    text = b"".join(
        b"TXXX" + len(v).to_bytes(4, "big") + b"\0\0" + v
        for v in (b"\0" + k.encode() + b"\0" + x.encode() for k, x in tags.items())
    )
    frames = []
    for at in range(0, len(payload), _FULL):
        body = payload[at : at + _FULL]
        frames.append(_frame(next(k for room, k in _ROOM if room >= len(body)), body))
    sizes = [3 * _RATES[8]] + [len(f) for f in frames]
    total = sum(sizes)
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    toc = bytes(min(255, ends[1 + len(frames) * k // 100] * 256 // total) for k in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return b"ID3\x03\0\0" + _syncsafe(len(text)) + text + _frame(9, xing) + b"".join(frames)


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """User text of an ID3v2.3 tag, and where the audio starts."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    tags, at = {}, 10
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 4] == b"TXXX":
            key, _, value = data[at + 11 : at + 10 + size].partition(b"\0")
            tags[key.decode("latin-1")] = value.decode("latin-1")
        at += 10 + size
    return tags, end


def parse(data: bytes) -> dict:
    """Tags, table, frames and payload area of an MPEG stream; damage is counted in ``resyncs`` and ``bad_crc``."""
    tags, at = _tags(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    out = {"tags": tags, "table": "", "declared": None, "resyncs": 0, "bad_crc": 0, "checked": 0}
    offsets, bodies, ticks, rates, lost = [], [], {}, {}, False
    first = True
    while at + 4 <= end:
        h = header(data, at)
        if h is None or at + h[0] > end:
            out["resyncs"] += not lost
            lost = True
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        size, samples, rate, kbps, layer, version, protected, mono = h
        if lost and at + size < end and header(data, at + size) is None:
            at += 1
            continue
        lost = False
        body = at + 4 + 2 * protected + (_side_bytes(version, mono) if layer == 3 else 0)
        if protected and layer == 3:
            out["checked"] += 1
            out["bad_crc"] += crc16(data[at + 2 : at + 4] + data[at + 6 : body]) != int.from_bytes(data[at + 4 : at + 6], "big")
        mark = data[body : body + 4]
        if first and mark in (b"Xing", b"Info"):
            flags = int.from_bytes(data[body + 4 : body + 8], "big")
            out["table"] = mark.decode()
            out["declared"] = int.from_bytes(data[body + 8 : body + 12], "big") if flags & 1 else None
        elif first and data[at + 36 : at + 40] == b"VBRI":
            out["table"], out["declared"] = "VBRI", int.from_bytes(data[at + 50 : at + 54], "big")
        else:
            offsets.append(at)
            bodies.append(data[body : at + size])
            ticks[rate] = ticks.get(rate, 0) + samples
            rates[kbps] = rates.get(kbps, 0) + 1
        first = False
        at += size
    out |= {"offsets": offsets, "data": b"".join(bodies), "duration_us": sum(n * 1_000_000 // r for r, n in ticks.items())}
    return out | {"kbps": dict(sorted(rates.items())), "ticks": ticks}


def write_media(docs: DataFrame, path: str) -> None:
    """Store (doc_id, media): each whole text, padded to a positive multiple of 64 bytes, as an MPEG stream."""

    def run(batches):
        for batch in parts(batches):
            media = []
            for text in text_bytes(batch):
                data = text or b""
                padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
                media.append(wrap(padded, {"text_bytes": str(len(data)), "payload_bytes": str(len(padded))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    doc_texts(docs).mapInArrow(run, "doc_id long, media binary").write.option("compression", "zstd").parquet(path)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, durations string, seek_offsets array<long>"
)


def read_media(media: DataFrame, seek_every: int = 32) -> DataFrame:
    """Parse stored streams: sizes and digests of what is read back, durations, seek offsets and checksum results.

    durations has the samples of each sampling rate as samples/rate, which is exact; seek_offsets has the byte place of every
    frame, feature those of every ``seek_every``-th one.
    """

    def row(data: bytes) -> tuple:
        x = parse(data)
        payload = x["data"][: int(x["tags"].get("payload_bytes", len(x["data"])))]
        feature = {
            "frames": len(x["offsets"]),
            "table": f"{x['table']}/{x['declared']}",
            "duration_us": x["duration_us"],
            "crc": f"{x['checked'] - x['bad_crc']}/{x['checked']}",
            "resyncs": x["resyncs"],
            "kbps": "+".join(f"{k}x{n}" for k, n in x["kbps"].items()),
            "seek": "+".join(map(str, x["offsets"][::seek_every])),
        }
        return (
            int(x["tags"].get("text_bytes", len(payload))),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
            len(data),
            hashlib.sha256(data).hexdigest(),
            ";".join(f"{k}={v}" for k, v in feature.items()),
            "+".join(f"{n}/{r}" for r, n in sorted(x["ticks"].items())),
            x["offsets"],
        )

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [row(x or b"") for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op7(docs: DataFrame) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/media"
    write_media(docs, path)
    stored = docs.sparkSession.read.schema("doc_id long, media binary").parquet(path)
    return read_media(stored).select("*", F.substring_index(F.split_part("feature", F.lit("duration_us="), F.lit(2)), ";", 1).cast("long").alias("duration_us"))
