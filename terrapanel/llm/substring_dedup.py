"""Substring dedup: de Bruijn compaction of repeated token k-mers, verified at source coordinates.

An edge of the graph is a window of ``window`` words, from the node of its first ``window`` - 1 words to that of its last ones.

1. Consecutive edges whose smallest ``anchor``-word hash stands at the same place form one path; the same words always give the
   same paths, so equal edges meet in equal paths or under one anchor, and a corpus shuffles about one row for eight edges. An
   anchor with one path has only nodes of one way in and out inside it. Where an anchor leads to several paths the graph
   branches, and the earliest of these paths are opened into their edges.
2. Paths and edges found at several places are repeated units. Successive units of a document share the node between them. Ways
   in and out of a unit's end nodes are counted over all its places, and units joined by a node with one way in and one way out
   compact into one long path: chains are runs of adjacent source places, and one join puts them on the places of their first unit.
3. For every long path the words at its source (the first place) and at each later place are brought together and compared; only
   spans whose words are equal are removed.

Copies of a whole text are found first, by digest, and never enter the graph. Before the shuffle, each Arrow batch marks units
whose words an earlier place of the same batch has; they are repeats already and are dealt out evenly, so a passage in a third of
all documents sends one row a batch to its task. All comparisons are "earlier by (doc_id, start)".

Defined results: null text has no words; a document with fewer than ``window`` words loses nothing; a null doc_id counts
as smaller than all others; rows that share a doc_id are compared with each other as parts of one document (places that tie are
not earlier) but each loses only its own repeated words and gives its own output row; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, blank_words, doc_texts, limited_broadcast, parts, sha256_hex, staged, text_bytes

_MULTIPLIER = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(31)
#: A span is packed as start * 2**_COUNT_BITS + number of windows.
_COUNT_BITS = 31
#: Digests or doc_ids (under 60 bytes each) that may be broadcast; more of them meet the texts by a shuffle.
BROADCAST_ROWS = 500_000

#: A unit of n windows at word ``at`` of row (k, h); late: an earlier place of the same batch has its words.
ROWS = "anchor long, body long, k long, h long, at int, n int, late boolean"
#: A unit's place and its source, the first place of its words.
PLACES = ["k", "h", "at", "n", "sk", "sh", "sat"]


def _marked(anchor, body, key, tag, at, n, same) -> pa.RecordBatch:
    """Rows of one batch. Late rows, for which same(i, first) confirms equal words, get a scattered anchor and no body."""
    order = np.lexsort((tag, at, key, body, anchor))
    anchor, body, key, tag, at, n = (x[order] for x in (anchor, body, key, tag, at, n))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    late = (key != key[first]) | (at != at[first])
    for i in np.flatnonzero(late).tolist():
        late[i] = same(order[i], order[first[i]])
    scattered = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    anchor = np.where(late, scattered, anchor.astype(np.uint64)).view(np.int64)
    arrays = [pa.array(anchor), pa.array(body.view(np.int64), mask=late), *map(pa.array, (key, tag, at, n, late))]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ROWS.split(", ")])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _kmer_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    power = np.uint64(_MULTIPLIER)
    for j in range(k):
        out = out * power + h[j : len(out) + j]
    out ^= out >> _SHIFT
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> _SHIFT)


def _bounds(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one blank, and the byte places where each begins and ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate([[0], ends[:-1] + 1]), ends


def paths(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows of ROWS: the paths of every document; n windows from word ``at``."""

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            columns: list[list] = [[], [], [], [], [], []]
            texts, places = [], []
            for key, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), strict=True):
                words = blank_words(text)
                if len(words) < window:
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                order = _kmer_hashes(hashes, anchor)
                place = np.lib.stride_tricks.sliding_window_view(order, window - anchor + 1).argmin(1)
                place = place + np.arange(len(place))
                starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
                counts = np.diff(np.append(starts, len(place)))
                joined, first, last = _bounds(words)
                begin, end = first[starts], last[starts + counts + window - 2]
                columns[0].append(order[place[starts]])
                columns[1].append(np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64))
                columns[2].append(np.full(len(starts), key, np.int64))
                columns[3].append(np.full(len(starts), tag, np.int64))
                columns[4].append(starts.astype(np.int32))
                columns[5].append(counts.astype(np.int32))
                places.append(np.stack([np.full(len(starts), len(texts)), begin, end]))
                texts.append(joined)
            if texts:
                spot = np.concatenate(places, axis=1)
                words_at = lambda i: texts[spot[0, i]][spot[1, i] : spot[2, i]]  # noqa: B023, E731
                yield _marked(*[np.concatenate(c) for c in columns], lambda i, j: words_at(i) == words_at(j))  # noqa: B023

    return keyed.mapInArrow(run, ROWS)


def branch_windows(keyed: DataFrame, window: int) -> DataFrame:
    """Rows of ROWS: single windows (n = 1) of the listed paths of each document, with 96 bits of their hash."""

    def run(batches):
        for batch in parts(batches):
            out: list[tuple] = []
            texts, places = [], []
            rows = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), batch.column(3).to_pylist())
            for key, tag, text, packed in zip(*rows, strict=True):
                if packed is None:
                    continue
                words = blank_words(text)
                joined, first, last = _bounds(words)
                for x in packed:
                    at, n = x >> _COUNT_BITS, x & (1 << _COUNT_BITS) - 1
                    for s in range(at, min(at + n, len(words) - window + 1)):
                        a, b = first[s], last[s + window - 1]
                        h = xxhash.xxh3_128_digest(joined[a:b])
                        low, high = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:12], "little")
                        out.append((high, low, key, tag, s, 1))
                        places.append((len(texts), a, b))
                texts.append(joined)
            if out:
                kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
                words_at = lambda i: texts[places[i][0]][places[i][1] : places[i][2]]  # noqa: B023, E731
                columns = [np.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield _marked(*columns, lambda i, j: words_at(i) == words_at(j))  # noqa: B023

    return keyed.mapInArrow(run, ROWS)


def _judged(rows: DataFrame) -> DataFrame:
    """Rows by anchor with their source and the number of places of their unit."""
    unit = Window.partitionBy("anchor", "body")
    first = F.first(F.struct("k", "at", "h")).over(unit.orderBy("k", "at", "h"))
    rows = rows.repartition("anchor").withColumn("source", first).withColumn("count", F.count("*").over(unit))
    return rows.withColumns({"sk": F.col("source.k"), "sh": F.col("source.h"), "sat": F.col("source.at")}).drop("source")


def _first(rows: DataFrame):
    return (F.col("k") == F.col("sk")) & (F.col("at") == F.col("sat"))


def _packed():
    return (F.shiftleft(F.col("at").cast("long"), _COUNT_BITS) + F.col("n")).alias("span")


def units(keyed: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(late spans (k, h, span) found inside a batch, places (PLACES) of units that several batches hold)."""
    found = _judged(paths(keyed, window, anchor))
    by_anchor = Window.partitionBy("anchor")
    ranged = found.withColumn("low", F.min("body").over(by_anchor)).withColumn("high", F.max("body").over(by_anchor))
    # Both uses of the paths read all their columns, so that one exchange serves both.
    branching = ranged.where("not late and low <> high").where(_first(ranged)).select("k", "h", _packed())
    wanted = found.where("late or count > 1").select(*PLACES, "late")
    opened = branching.groupBy("k", "h").agg(F.collect_list("span").alias("spans"))
    windows = _judged(branch_windows(keyed.join(opened, ["k", "h"], "left"), window)).where("late or count > 1").select(*PLACES, "late")
    both = staged(wanted.unionByName(windows), "units")
    return both.where("late").select("k", "h", _packed()), both.where("not late").select(*PLACES)


def compacted(places: DataFrame) -> DataFrame:
    """Rows (PLACES) of long paths at their later places: n windows of a chain of units, whose nodes inside have one way in and one
    way out, and the chain's source.

    A unit is its source place and its windows. Each unit's successor and predecessor are the units that share a node with it at
    each of its places; a unit joins its successor where both see only each other. The first place of the successor is then right
    behind that of the unit, so that chains are runs of adjacent source places.
    """
    edge = F.col("n") == 1  # opened edges lie over the paths they come from, so the two are chained apart
    row = Window.partitionBy("k", "h", edge).orderBy("at")
    unit = F.struct("sk", "sh", "sat", "n")
    follows = lambda x, mine: F.when(mine, x)
    seen = places.withColumns(
        {
            "after": follows(F.lead(unit).over(row), F.lead("at").over(row) == F.col("at") + F.col("n")),
            "before": follows(F.lag(unit).over(row), F.lag("at").over(row) + F.lag("n").over(row) == F.col("at")),
        }
    )
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    degrees = seen.groupBy("sk", "sh", "sat", "n").agg(
        F.coalesce(one("after"), F.lit(False)).alias("one_out"), F.coalesce(one("before"), F.lit(False)).alias("one_in"), F.min("after").alias("next")
    )
    # A unit joins the one that lies right before it at its source, where the node between them has no other way in or out.
    source = Window.partitionBy("sk", "sh", edge).orderBy("sat")
    joins = F.lag("one_out").over(source) & F.col("one_in") & (F.lag("next").over(source) == unit)
    chains = degrees.withColumn("inner", F.coalesce(joins, F.lit(False)))
    chains = chains.withColumn("edge", edge).withColumn("chain", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(source))
    heads = chains.groupBy("sk", "sh", "edge", "chain").agg(F.min_by("n", "sat").alias("n"), F.min("sat").alias("sat"), F.sum("n").alias("total"))
    later = places.where(~_first(places))
    return later.join(heads.select("sk", "sh", "sat", "n", "total"), ["sk", "sh", "sat", "n"]).withColumn("n", F.col("total").cast("int")).select(*PLACES)


def confirmed(keyed: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The spans (k, h, span) of rows (PLACES) whose words equal those at their source."""
    own = spans.select("k", "h", F.struct("at", "n", "sk", "sh", "sat", F.lit(False).alias("source")).alias("s"))
    sources = spans.select(*PLACES[3:]).distinct()
    at_source = sources.select(F.col("sk").alias("k"), F.col("sh").alias("h"), F.struct(F.col("sat").alias("at"), "n", "sk", "sh", "sat", F.lit(True).alias("source")).alias("s"))
    lists = own.unionByName(at_source).groupBy("k", "h").agg(F.collect_list("s").alias("spans"))
    schema = "sk long, sh long, sat int, n int, source boolean, k long, h long, at int, words binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def read(batches):
        for batch in parts(batches):
            out = []
            rows = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), batch.column(3).to_pylist())
            for key, tag, text, spans_ in zip(*rows, strict=True):
                joined, first, last = _bounds(blank_words(text))
                for s in spans_:
                    words = joined[first[s["at"]] : last[s["at"] + s["n"] + window - 2]]
                    out.append((s["sk"], s["sh"], s["sat"], s["n"], s["source"], key, tag, s["at"], words))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def compare(batches):
        source, words = None, None
        for batch in parts(batches, column="words"):
            keep = []
            for *path, is_source, own_words in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 8)), strict=True):
                if is_source:
                    source, words = path, own_words
                keep.append(not is_source and path == source and own_words == words)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["k", "h", "at", "n"])

    read_rows = keyed.join(lists, ["k", "h"]).mapInArrow(read, schema)
    path = ["sk", "sh", "sat", "n"]
    return read_rows.repartition(*path).sortWithinPartitions(*path, F.col("source").desc()).mapInArrow(compare, "k long, h long, at int, n int").select("k", "h", _packed())


def sources_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (k, h, text) that enter the graph, rows (k, h, text) that copy the whole text of a smaller doc_id).

    h is a hash of the text where a doc_id has several texts, else 0.
    """
    text = F.col("text")
    rows = doc_texts(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), "text")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    repeated = rows.groupBy(digest.alias("digest")).agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared = rows.groupBy("k").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("k", F.lit(True).alias("several"))
    repeated, shared = (limited_broadcast(staged(x, name), BROADCAST_ROWS) for x, name in ((repeated, "repeated"), (shared, "shared_ids")))
    flagged = rows.withColumn("digest", digest).join(repeated, "digest", "left").join(shared, "k", "left")
    flagged = flagged.select("k", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).alias("h"), "text", F.coalesce(F.col("k") > F.col("first"), F.lit(False)).alias("copy"))
    return flagged.where("not copy").drop("copy").repartition("k", "h"), flagged.where("copy").drop("copy")


def dedup(docs: DataFrame, window: int = 20, anchor: int = 6, keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256[, kept]) after words in repeated windows are removed."""
    keyed, copies = sources_of(docs)
    late, places = units(keyed, window, anchor)
    removed = late.unionByName(confirmed(keyed, compacted(places), window))
    lists = removed.groupBy("k", "h").agg(F.collect_list("span").alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def run(batches):
        for batch in parts(batches):
            out: list[tuple] = []
            for key, text, packed in zip(batch.column(0).to_pylist(), text_bytes(batch), batch.column(3).to_pylist(), strict=True):
                words = blank_words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                if packed:
                    spans = np.array(packed, np.int64)
                    starts = spans >> _COUNT_BITS
                    stops = np.minimum(starts + (spans & (1 << _COUNT_BITS) - 1) + window - 1, len(words))
                    np.add.at(gone, np.minimum(starts, len(words)), 1)
                    np.add.at(gone, stops, -1)
                keep = np.cumsum(gone)[: len(words)] == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                row = (None if key == NULL_ID else key, len(words), len(words) - int(keep.sum()), sha256_hex(kept))
                out.append(row + (kept.decode(),) * keep_text)
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    # A copy loses every word if it has a window at all: one span over all its words.
    whole = F.when(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")) >= window, F.array(F.lit((1 << _COUNT_BITS) - 1)))
    kept_rows = keyed.join(lists, ["k", "h"], "left").mapInArrow(run, schema)
    return kept_rows.unionByName(copies.withColumn("spans", whole).mapInArrow(run, schema))


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs)
