"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints that differ in at most 3 bits agree in one of four 16-bit blocks; the other 48 bits then hold at most 3
errors, so one of their two 23-bit segments holds at most one. The perfect (23,12) Golay code decodes every 23-bit word to
one codeword within distance 3; a segment's keys are the codewords of the segment and of its 23 neighbours (one or six
different ones), and two segments with at most one error share a key. A bucket is (block, its bits, segment, codeword
index): 28 selective bits. Distinct fingerprints of a bucket are compared bit for bit; large buckets give a spanning forest
of their links instead of all pairs, and hot ones are dealt out in parts, so no link between components is lost.

Defined results: null text and text without words have fingerprint zero and are linked like others; fewer words than a
shingle make one shingle; every input row gives one output row; a null doc_id counts only where a component has no other
id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blank_words, doc_texts, limited_broadcast, parts, row_key, staged, text_bytes
from .components import bucket_links, components, hot_buckets

_SEED = 42
#: Row keys (about 40 bytes each) that may be broadcast; more of them meet the texts by a shuffle.
BROADCAST_KEYS = 500_000
#: Generator of the cyclic (23,12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` lower-cased words (of all words where there are fewer)."""
    words = blank_words(text.lower() if text else None)
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, take = b" ".join(words), min(size, len(words))
    spans = zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], _SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, fp): the 64-bit fingerprint as a signed integer."""

    def run(batches):
        for batch in parts(batches):
            values = np.array([majority(shingle_hashes(t, shingle)) for t in text_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and the error of least weight for each 11-bit syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << bit - 11
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], np.int32)
    leader = np.zeros(2048, np.int32)
    for weight in (3, 2, 1):
        for places in itertools.combinations(range(23), weight):
            error = sum(1 << p for p in places)
            leader[remainder(error)] = error
    leader[0] = 0
    return parity, leader


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Message bits of the Golay codeword within distance 3 of each 23-bit word."""
    parity, leader = _golay()
    return (words ^ leader[(words & 0x7FF) ^ parity[words >> 11]]) >> 11


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of its 23 neighbours: 24 columns, sorted, repeats as -1."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int32)
    keys = np.sort(codeword_index(words.astype(np.int32)[:, None] ^ flips[None, :]), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def golay_keys(distinct: DataFrame) -> DataFrame:
    """Rows (bucket, node, data) of each distinct fingerprint."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            buckets, nodes = [], []
            for block in range(4):
                at = np.uint64(16 * block)
                own = (fp >> at & np.uint64(0xFFFF)).astype(np.int64)
                low = fp & (np.uint64(1) << at) - np.uint64(1)
                rest = low | (fp >> at >> np.uint64(16)) << at
                for segment in range(2):
                    keys = fuzzy_keys((rest >> np.uint64(23 * segment) & np.uint64(0x7FFFFF)).astype(np.int32))
                    row, column = np.nonzero(keys >= 0)
                    head = np.int64(block * 2 + segment) << 28
                    buckets.append(head | own[row] << 12 | keys[row, column].astype(np.int64))
                    nodes.append(fp.view(np.int64)[row])
            node = pa.array(np.concatenate(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), node, node], names=["bucket", "node", "data"])

    return distinct.mapInArrow(run, "bucket long, node long, data long")


def within_bits(bits: int):
    def predicate(data):
        fp = data.astype(np.int64).view(np.uint64)
        return lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= bits

    return predicate


def fingerprint_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most ``bits`` (0 to 3) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    return bucket_links(golay_keys(prints.select("fp").distinct()), within_bits(bits))


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    roots = components(fingerprint_links(prints, bits))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates for the pipeline: five-word shingles, similarity 0.8 or more.

#: Bands of MinHash values: a pair with a Jaccard similarity of 2/3 (cosine 0.8 of sets of one size) shares one with probability 0.994.
_BANDS, _ROWS = 36, 5
_PRIME_MIX = np.uint64(0x9E3779B97F4A7C15)


def _minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the distinct shingles; 2048 shingles at a time."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        best = np.minimum(best, (hashes[at : at + 2048, None] * a + b).min(0))
    return best


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (key, digest, fp, bands): the row's key, digest of the lower-cased words, fingerprint and MinHash band hashes."""
    names = ["key", "digest", "fp", "bands"]

    def run(batches):
        random = np.random.default_rng(_SEED)
        a = random.integers(1, 2**63, _BANDS * _ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = random.integers(0, 2**63, _BANDS * _ROWS, dtype=np.uint64)
        for batch in parts(batches):
            out = []
            for text in text_bytes(batch):
                hashes = shingle_hashes(text, shingle)
                values = _minhash(np.unique(hashes), a, b)
                mixed = (values ^ values >> np.uint64(29)) * _PRIME_MIX
                digest = xxhash.xxh3_128_digest(b" ".join(blank_words(text.lower() if text else None)))
                bands = [
                    int.from_bytes(xxhash.xxh3_64_digest(bytes([k]) + row.tobytes()), "little", signed=True)
                    for k, row in enumerate(mixed.reshape(_BANDS, _ROWS))
                ]
                out.append((digest, int(np.uint64(majority(hashes)).astype(np.int64)), bands))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    rows = doc_texts(docs).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest binary, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, data) from rows (node, text): sorted distinct 64-bit shingle hashes."""

    def run(batches):
        for batch in parts(batches):
            data = [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["node", "data"])

    return texts.select("node", "text").mapInArrow(run, "node long, data binary")


def similar(threshold: float, measure: str = "jaccard"):
    """Whether two shingle sets have a similarity of at least the threshold, by exact counts.

    ``jaccard`` is shared over all different shingles, ``cosine`` shared over the geometric mean of the sets' sizes: the share of
    shingles that an edited copy keeps.
    """
    if measure not in ("jaccard", "cosine"):
        raise ValueError(f"unknown measure {measure}")
    # The least share of sizes at which the threshold can be met.
    sized = threshold if measure == "jaccard" else threshold**2

    def predicate(data):
        sets = [np.frombuffer(x, "<u8") for x in data]
        sizes = np.array([len(x) for x in sets], np.int64)

        def common(i, j):
            """Shared shingles of row i[0] with each of the rows j, 256 rows at a time."""
            own, out = sets[i[0]], np.zeros(len(j), np.int64)
            for at in range(0, len(j) if len(own) else 0, 256):
                part = j[at : at + 256]
                other = np.concatenate([sets[x] for x in part])
                found = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                sums = np.concatenate([[0], np.cumsum(found)])
                stops = np.cumsum(sizes[part])
                out[at : at + 256] = sums[stops] - sums[stops - sizes[part]]
            return out

        def near(i, j):
            if not len(i):
                return np.zeros(0, bool)
            both = np.zeros(len(i), np.int64)
            least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            open_ = np.flatnonzero(least >= sized * most - 1e-9)
            if len(open_) > 1 and (i == i[0]).all():
                both[open_] = common(i, j[open_])
            else:
                for p in open_.tolist():
                    both[p] = len(np.intersect1d(sets[i[p]], sets[j[p]], assume_unique=True))
            if measure == "cosine":
                return both >= threshold * np.sqrt(np.maximum(sizes[i] * sizes[j], 1)) - 1e-9
            return both / np.maximum(sizes[i] + sizes[j] - both, 1) >= threshold

        return near

    return predicate


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets with two nodes or more; buckets with the same nodes become one. Hot buckets, known from a
    sketch, are shared without being gathered."""
    hot = hot_buckets(keys)
    cold = keys.where(~F.col("bucket").isin(hot)) if hot else keys
    own = Window.partitionBy("bucket")
    what = [F.count("*").over(own), F.min("node").over(own), F.max("node").over(own), F.bit_xor(F.xxhash64("node")).over(own)]
    sized = cold.repartition("bucket").select("node", *[x.alias(f"w{k}") for k, x in enumerate(what)]).where("w1 < w2")
    shared = sized.select(F.xxhash64("w0", "w1", "w2", "w3").alias("bucket"), "node")
    if hot:
        shared = shared.unionByName(keys.where(F.col("bucket").isin(hot)).select("bucket", "node"))
    return shared.distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, measure: str = "jaccard") -> DataFrame:
    """Rows (key, root) of all rows: root is the key of the group's first row, by doc_id and then by the text's hashes.

    Exact copies (equal words) meet by digest. Candidates are pairs whose fingerprints the Golay keys link, and documents
    that share a MinHash band, because shingle sets of similarity 0.8 usually differ in more than 3 fingerprint bits.
    Only documents of buckets with a second member have their shingle sets made and compared, exactly.
    """
    rows = staged(signatures(docs, shingle), "signatures")
    first = rows.groupBy("digest").agg(F.min(F.struct("key", "fp", "bands")).alias("r"))
    firsts = staged(first.select("digest", "r.*", F.monotonically_increasing_id().alias("node")), "firsts")
    prints = firsts.groupBy("fp").agg(F.min("node").alias("node"))
    linked = fingerprint_links(firsts, 3)
    by_print = linked.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(
        prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b"
    )
    same = firsts.select("fp", F.col("node").alias("x")).join(prints.withColumnRenamed("node", "y"), "fp").where("x <> y")
    pairs = by_print.select("x", "y").unionByName(same.select("x", "y"))
    pair_keys = pairs.select(F.xxhash64("x", "y").alias("bucket"), F.explode(F.array("x", "y")).alias("node"))
    bands = firsts.select(F.explode("bands").alias("bucket"), "node")
    pair_keys = staged(pair_keys, "pair_keys")
    shared = staged(shared_buckets(bands.unionByName(pair_keys)), "shared")
    needed = staged(firsts.select("key", "node").join(shared.select("node").distinct(), "node", "left_semi"), "needed")
    texts = doc_texts(docs).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    texts = texts.join(limited_broadcast(needed, BROADCAST_KEYS), "key").select("node", "text")
    sets = staged(shingle_sets(texts, shingle), "sets").groupBy("node").agg(F.first("data").alias("data"))
    roots = components(bucket_links(shared.join(sets, "node"), similar(threshold, measure)))
    placed = firsts.select("digest", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("key").alias("least"))
    heads = placed.join(least, "root").select("digest", F.col("least").alias("root"))
    return rows.select("key", "digest").join(heads, "digest").select("key", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, measure: str = "jaccard") -> DataFrame:
    """The documents with one of each near-duplicate group, the first by doc_id (a null one comes first); see ``similar``.

    Rows that share a doc_id are judged apart by their texts; of rows with the same doc_id and text one stays. Null texts and texts
    without words are copies of each other. All columns stay unchanged, whatever their names; an empty table gives no rows.
    """
    keyed = near_duplicate_groups(docs, shingle, threshold, measure).groupBy("key").agg(F.first("root").alias("root"), F.count("*").alias("n"))
    judged = staged(keyed, "judged")
    name = f"key_{uuid.uuid4().hex}"
    on = row_key(F.col("doc_id"), F.col("text").cast("string")) == F.col(name)
    gone = judged.where("key <> root").select(F.col("key").alias(name))
    kept = docs.join(limited_broadcast(gone, BROADCAST_KEYS), on, "left_anti")
    repeated = judged.where("key = root and n > 1").select(F.col("key").alias(name))
    if repeated.isEmpty():
        return kept
    repeated = limited_broadcast(repeated, BROADCAST_KEYS)
    return kept.join(repeated, on, "left_anti").unionByName(kept.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "text"]))
