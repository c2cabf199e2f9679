"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives its windows of ``window`` words as patterns (a shorter item is one pattern). Patterns of
one length share a shift table over two-word blocks, buckets keyed by the last block, and a direct comparison of
the whole pattern. Document words outside the benchmark's vocabulary let the search jump a whole pattern length.

The benchmark is read in blocks of at most ``block_bytes`` of text, each broadcast on its own, so that neither the
driver nor a task ever holds more than one block's tables; each document batch is searched with every block.

Defined results: null or empty text has no words and no hits; a null item text or an item without words gives no
pattern; repeated item_ids count once; null item_id rows are ignored; every input row gives one output row, repeated
doc_ids included; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, doc_texts, keep_rows, parts, text_bytes

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


class _Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, size: int, patterns: dict[tuple[int, ...], set[str]]):
        self.size, self.patterns = size, patterns
        self.shift: dict[tuple[int, int], int] = {}
        self.bucket: dict[tuple[int, int], set[tuple[int, int]]] = {}
        if size > 1:
            for p in patterns:
                for q in range(1, size):
                    block, far = (p[q - 1], p[q]), size - 1 - q
                    if far < self.shift.get(block, size):
                        self.shift[block] = far
                self.bucket.setdefault((p[-2], p[-1]), set()).add((p[0], p[1]))

    def search(self, ids: list):
        """Starts of all occurrences with the items that own the pattern."""
        m, n = self.size, len(ids)
        if m == 1:
            for i, x in enumerate(ids):
                if x is not None and (owners := self.patterns.get((x,))):
                    yield i, owners
            return
        shift, bucket, patterns, i = self.shift.get, self.bucket, self.patterns, m - 1
        while i < n:
            last = ids[i]
            if last is None:
                i += m
                continue
            block = (ids[i - 1], last)
            jump = shift(block, m - 1)
            if jump:
                i += jump
                continue
            start = i - m + 1
            if (ids[start], ids[start + 1]) in bucket[block] and (owners := patterns.get(tuple(ids[start : i + 1]))):
                yield start, owners
            i += 1


class _Block:
    """Search tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text))
            if not ids:
                continue
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1):
                by_size.setdefault(size, {}).setdefault(ids[s : s + size], set()).add(item)
        self.groups = [_Patterns(size, p) for size, p in sorted(by_size.items())]

    def hits(self, words: list[bytes]):
        ids = list(map(self.vocabulary.get, words))
        for group in self.groups:
            for start, owners in group.search(ids):
                yield start, start + group.size, owners


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of (item_id, text) lists, each of about ``block_bytes`` of text at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_bytes))
    blocks = []
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        blocks.append(spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in part.toLocalIterator()]))
    return blocks


def _search(blocks: list, window: int):
    """A function from texts to (words, merged hit spans, item ids) of each; one block's tables are held at a time."""
    held: list = []

    def search(texts: list) -> tuple[list, list, list]:
        words = [alnum_words(t) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in words]
        items: list[set[str]] = [set() for _ in words]
        for block in blocks:
            if len(blocks) > 1 or not held:
                held[:] = [_Block(block.value, window)]
            for k, w in enumerate(words):
                for s, e, owners in held[0].hits(w):
                    spans[k].append((s, e))
                    items[k] |= owners
        return words, [_merge(x) for x in spans], items

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, item_ids, hit_spans): words inside any occurrence of a benchmark window."""
    blocks = benchmark_blocks(benchmark, block_bytes)

    def run(batches):
        search = _search(blocks, window)
        for batch in parts(batches) if len(blocks) == 1 else batches:
            words, merged, items = search(text_bytes(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sum(e - s for s, e in x) for x in merged], pa.int64()),
                    pa.array([sorted(x) for x in items], _ARROW.field("item_ids").type),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in merged], _ARROW.field("hit_spans").type),
                ],
                schema=_ARROW,
            )

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """The documents in which no benchmark window occurs. All columns stay unchanged, whatever their names; null and empty texts have
    no words and stay; rows that share a doc_id are judged by their own texts; an empty table gives no rows."""
    blocks = benchmark_blocks(benchmark, block_bytes)

    def keeper():
        search = _search(blocks, window)
        return lambda texts: [not x for x in search(texts)[1]]

    return keep_rows(docs, keeper)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join("item_ids", ",").alias("item_ids"),
    )

