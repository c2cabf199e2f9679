"""Token-ID output as sorted-string-table shards.

A shard holds the documents of one range of identifiers: data blocks of entries in ascending order (keys share a prefix with
the entry before; every 16th entry is written in full), a sparse index of the blocks, a Bloom filter of the keys, and a footer
with the places of both. Sections are the binary rows of a Parquet table, so that Spark's commit makes a shard
appear whole or not at all on any store; put together by ``seq`` they are the file, which ``export_shard`` writes.

  data    n entries u32 | ids before the block in its shard u64 | id width u8 | entries | crc32 u32
  entry   shared u8 | rest u8 | number of ids u32 | rest of the key | ids
  index   per block: last key 8 | offset u64 | size u32
  filter  number of probes u8 | bits
  footer  index offset u64 | index size u32 | filter offset u64 | filter size u32 | documents u64 | ids u64 | first key | last key |
          sizes of both keys u8 | magic

Keys are doc_ids as 8 big-endian bytes with the sign bit turned, so that bytes sort as numbers do; a null doc_id is an empty
key, before all others.

Defined results: null text has the end id only; rows that share a doc_id stand one after another; a null doc_id comes first; extra
columns are ignored; an empty table gives no shard. Rows are dealt to shards by ranges of (doc_id, hash of the text), so that rows
with one doc_id (a null one, say) don't all meet in one task.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import codec
from .common import doc_texts, shared_dir

MAGIC = b"TERRASST"
RESTART, PROBES, BITS_A_KEY = 16, 7, 10
SECTIONS = "shard int, seq int, section string, first long, last long, data binary"
_HEAD, _ENTRY, _FOOT = "<IQB", "<BBI", "<QIQIQQ8s8sBB8s"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def pack_block(entries: list[tuple[bytes, np.ndarray]], before: int, width: int) -> bytes:
    """A data block; width is 2 or 4 bytes an id."""
    out, last = [struct.pack(_HEAD, len(entries), before, width)], b""
    for k, (key, ids) in enumerate(entries):
        shared = 0
        if k % RESTART:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        out += [struct.pack(_ENTRY, shared, len(key) - shared, len(ids)), key[shared:], ids.astype(f"<u{width}", copy=False).tobytes()]
        last = key
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes):
    """Entries (key, ids, ids before it in the shard) of a data block; its checksum must hold."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a data block is damaged")
    n, before, width = struct.unpack_from(_HEAD, data)
    at, key = struct.calcsize(_HEAD), b""
    for _ in range(n):
        shared, rest, count = struct.unpack_from(_ENTRY, data, at)
        at += struct.calcsize(_ENTRY)
        key = key[:shared] + data[at : at + rest]
        at += rest
        yield key, np.frombuffer(data, f"<u{width}", count, at), before
        at += count * width
        before += count


def _probes(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + k * b) % 2**64 % n_bits for k in range(PROBES)]


def pack_filter(keys: set[bytes]) -> bytes:
    n_bits = max(64, BITS_A_KEY * len(keys))
    bits = np.zeros(n_bits, np.uint8)
    for key in keys:
        bits[_probes(key, n_bits)] = 1
    return struct.pack("<BI", PROBES, n_bits) + np.packbits(bits, bitorder="little").tobytes()


def may_hold(data: bytes, key: bytes) -> bool:
    _, n_bits = struct.unpack_from("<BI", data)
    return all(data[5 + p // 8] >> p % 8 & 1 for p in _probes(key, n_bits))


def write_shards(docs: DataFrame, out: str, path: str, pattern: str, end_id: int = 0, block_bytes: int = 1 << 18) -> None:
    """Encode every whole text, append ``end_id`` and write shards in ascending doc_id order below ``out``."""

    def run(batches):
        shard = TaskContext.get().partitionId()
        bpe = codec(path, pattern)
        width = 2 if max(len(bpe.token_bytes) - 1, end_id) < 65536 else 4
        index, keys, held, ends = [], set(), [], []
        state = {"offset": 0, "ids": 0, "held_ids": 0, "size": 0, "seq": 0, "docs": 0}

        def section(kind, first, last, data):
            row = [[shard], [state["seq"]], [kind], [first], [last], [data]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            state["seq"] += 1
            arrays = [pa.array(c, t) for c, t in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SECTIONS.split(", ")])

        def flush():
            data = pack_block(held, state["ids"], width)
            first, last = held[0][0], held[-1][0]
            index.append(last.rjust(8, b"\0") + struct.pack("<QI", state["offset"], len(data)))
            state["offset"] += len(data)
            state["ids"] += state["held_ids"]
            state["held_ids"] = state["size"] = 0
            held.clear()
            return section("data", id_of(first), id_of(last), data)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, offsets in bpe.encode_parts(batch.column(1)):
                for k in range(len(offsets) - 1):
                    key = key_of(doc_ids[at + k])
                    keys.add(key)
                    held.append((key, np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype(f"<u{width}")))
                    ends[1:] = [key]
                    ends[:1] = ends[:1] or [key]
                    state["docs"] += 1
                    state["held_ids"] += len(held[-1][1])
                    state["size"] += len(held[-1][1]) * width
                    if state["size"] >= block_bytes:
                        yield flush()
        if held:
            yield flush()
        if state["docs"]:
            table, bloom = b"".join(index), pack_filter(keys)
            at = state["offset"]
            yield section("index", None, None, table)
            yield section("filter", None, None, bloom)
            sizes = map(len, (ends[0], ends[-1]))
            foot = struct.pack(_FOOT, at, len(table), at + len(table), len(bloom), state["docs"], state["ids"], ends[0], ends[-1], *sizes, MAGIC)
            yield section("footer", None, None, foot)

    order = [F.col("doc_id").asc_nulls_first(), F.col("spread")]
    rows = doc_texts(docs).withColumn("spread", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, SECTIONS).write.option("compression", "zstd").parquet(out)


def read_sections(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SECTIONS).parquet(out)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) parsed from the stored blocks."""
    sections = read_sections(spark, out)

    def totals(batches):
        for batch in batches:
            ids = [read_footer(x)["ids"] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], names=["shard", "ids"])

    footers = sections.where("section = 'footer'").select("shard", "data").mapInArrow(totals, "shard int, ids long")
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = footers.select("shard", F.coalesce(F.sum("ids").over(so_far), F.lit(0)).alias("shard_start"))

    def entries(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [
                    (shard, id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for key, ids, before in read_block(data)
                ]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    blocks = sections.where("section = 'data'").select("shard", "data")
    parsed = blocks.mapInArrow(entries, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return parsed.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_footer(data: bytes) -> dict:
    names = ("index_at", "index_size", "filter_at", "filter_size", "docs", "ids", "first", "last", "first_size", "last_size", "magic")
    foot = dict(zip(names, struct.unpack(_FOOT, data), strict=True))
    if foot["magic"] != MAGIC:
        raise ValueError("a footer is damaged")
    return foot | {k: foot[k][: foot[f"{k}_size"]] for k in ("first", "last")}


def lookup(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """Ids of each row with this doc_id: footers name the shards, then Bloom filter, binary search in the sparse index, and blocks."""
    key, found = key_of(doc_id), []
    sections = read_sections(spark, out)
    feet = {r["shard"]: read_footer(bytes(r["data"])) for r in sections.where("section = 'footer'").select("shard", "data").toLocalIterator()}
    for shard in sorted(k for k, foot in feet.items() if foot["first"] <= key <= foot["last"]):
        own = sections.where(F.col("shard") == shard)
        if not may_hold(bytes(own.where("section = 'filter'").first()["data"]), key):
            continue
        index = bytes(own.where("section = 'index'").first()["data"])
        lasts = [index[k : k + 8] for k in range(0, len(index), 20)]
        first = bisect_left(lasts, key)
        stop = first
        while stop < len(lasts) and (stop == first or lasts[stop - 1] == key):
            stop += 1
        for r in own.where((F.col("section") == "data") & F.col("seq").between(first, stop - 1)).orderBy("seq").collect():
            found += [ids for k, ids, _ in read_block(bytes(r["data"])) if k == key]
    return found


def export_shard(spark: SparkSession, out: str, shard: int, target: str) -> None:
    """Write one shard as one file, a section at a time, on the store that the target names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(conf).create(path, True)
    try:
        for r in read_sections(spark, out).where(F.col("shard") == shard).orderBy("seq").select("data").toLocalIterator():
            stream.write(bytearray(r["data"]))
    finally:
        stream.close()


def op6(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(docs.sparkSession)}/tokens"
    write_shards(docs, out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_shards(docs.sparkSession, out)
