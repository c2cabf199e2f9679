"""Alignment of two tokenizers' tokens by lockstep merging: one vector of pointers for all documents of a batch.

Every document is encoded by a byte-level BPE vocabulary (A) and a sentencepiece model (B). For both the byte ends of all tokens of
a batch stand in one array, and a NumPy state vector holds the pointers to the current A and B token of every document. One step
emits a link for each document, and a cut where both tokens end at the same byte; then each document advances the pointer whose
token ends first, or both, and finished documents leave the vector. A document of many tokens enters as several runs, which start
where both tokenizers end a token, so that one long document doesn't keep a nearly empty vector going.

Counts of linked id pairs are summed in each task first. The most frequent ``HOT_PAIRS`` pairs at most are broadcast with their
counts; links of other pairs meet theirs in a join by pair, one row for each document and pair. The texts are read and aligned
twice, so that no links are stored.

Both tokenizers start anew at a blank or line feed between other characters, so distinct units are encoded once and then met by
Arrow lookups; a sentencepiece model with a piece that spans such a place is refused. Texts with other runs of white space are
encoded whole.

Defined results: null and empty texts, and texts whose bytes a tokenizer doesn't give back (U+2581), have no tokens: zeros and ''.
Strings of special tokens are plain text. Every input row gives one output row, repeated rows and null doc_ids included; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _RUNS, ByteBpe, Known
from .common import doc_texts, parts, sha256_hex, staged

#: Bytes of text that are cut into units, and that are aligned, at a time (one text at least).
UNIT_BYTES, PART_BYTES = 4 << 20, 1 << 20
#: A tokens of a run of a long document, and further places tried for its start.
RUN, TRIES = 512, 16
#: Pairs broadcast with their counts (17 bytes each).
HOT_PAIRS = 1 << 20
#: Distinct pairs that a task gathers before it hands them on.
TASK_PAIRS = 2_000_000
#: Units that a worker remembers.
KNOWN_UNITS = 250_000
BLANK = "▁"


class Pieces:
    """The sentencepiece model: ids of units, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(BLANK in name.lstrip(BLANK) or "\n" in name for name in names):
            raise ValueError("a piece spans a blank or line feed")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(BLANK, " ").encode() for k, n in enumerate(names)]
        self.blank = self.model.piece_to_id(BLANK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each with a blank in front."""
        return [ids or [self.blank] for ids in self.model.encode(texts, num_threads=1)]


@dataclass
class Tokens:
    """Tokens of a part for both tokenizers: ids and offsets of its rows."""

    a: np.ndarray
    b: np.ndarray
    a_rows: np.ndarray
    b_rows: np.ndarray

    def rows(self, start: int, stop: int) -> Tokens:
        a, b = self.a_rows[start : stop + 1], self.b_rows[start : stop + 1]
        return Tokens(self.a[a[0] : a[-1]], self.b[b[0] : b[-1]], a - a[0], b - b[0])


@dataclass
class Links:
    """Places of linked A and B tokens of a part, in no order, and of the last A and B token of each group, ascending."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a, self.b = ByteBpe(a_path, pattern), Pieces(b_path)
        self.a_sizes = np.array([len(t) for t in self.a.token_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b.bytes], np.int64)
        self.b_bytes = pa.array(self.b.bytes, pa.large_binary())
        self.a_names, self.b_names = (
            [pa.array([f"{k}{end}".encode() for k in range(n)], pa.large_binary()) for end in ends] for n, ends in ((len(self.a.token_bytes), ",|"), (len(self.b.bytes), ",;"))
        )
        #: Runs of B ids of the units, in the order in which A's codec knows them.
        self.b_units = Known()

    def _b_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """B ids of units; none for a unit whose bytes they don't give back."""
        names = units.to_pylist()
        found = self.b.encode(names)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        # A unit that a line feed leads has no blank.
        led = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
        ids = np.delete(ids, (np.cumsum(counts) - counts)[led])
        counts -= led
        ends = np.cumsum(counts)
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False) + ~led
        spelled = np.concatenate([[0], np.cumsum(self.b_sizes[ids])])
        raw = "".join(name if lead else " " + name for name, lead in zip(names, led.tolist(), strict=True)).encode()
        _, _, data = self.b_bytes.take(pa.array(ids)).buffers()
        same = (spelled[ends] == np.cumsum(sizes)).all() and bytes(memoryview(data)[: spelled[-1]]) == raw
        if not same:
            given = [b"".join(map(self.b.bytes.__getitem__, x)) for x in np.split(ids, ends[:-1])]
            kept = np.array([x == (name if lead else " " + name).encode() for x, name, lead in zip(given, names, led, strict=True)])
            ids, counts = ids[np.repeat(kept, counts)], np.where(kept, counts, 0)
        return ids, counts

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A ids of units met for the first time; their B ids are noted at the same places."""
        ids, counts = self._b_units(units)
        known = self.b_units
        known.starts = np.concatenate([known.starts, (len(known.pool) + np.cumsum(counts) - counts).astype(np.int32)])
        known.counts, known.pool = np.concatenate([known.counts, counts.astype(np.int32)]), np.concatenate([known.pool, ids])
        return self.a._cut_units(units)

    def tokens(self, texts: pa.Array) -> Tokens:
        """Tokens of a blank and each text; none for texts that are null, empty or not given back."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(pc.filter(texts, pa.array(~(apart | empty))), "\n", " \n"), " ")
        places, words = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        if len(self.a.units.strings) > KNOWN_UNITS:
            self.a.units, self.b_units = Known(), Known()
        if len(self.a.pieces.strings) > KNOWN_UNITS:
            self.a.pieces = Known()
        slots = self.a.units.slots(words.dictionary, self._units)[words.indices.to_numpy()]
        (a, a_counts), (b, b_counts) = ((x.ids(x.starts[slots], x.counts[slots]), x.counts[slots]) for x in (self.a.units, self.b_units))
        lost = np.concatenate([[0], np.cumsum(b_counts == 0)])[places]
        if not (apart | empty).any() and not (np.diff(lost) > 0).any():
            a_rows, b_rows = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[places] for n in (a_counts, b_counts))
        else:
            own = [np.split(ids, np.concatenate([[0], np.cumsum(n)])[places][1:-1]) if len(places) > 1 else [] for ids, n in ((a, a_counts), (b, b_counts))]
            rows, k = [], 0
            none = np.zeros(0, np.uint32)
            for i in range(len(texts)):
                if empty[i]:
                    rows.append((none, none))
                elif apart[i]:
                    rows.append(self._whole(texts[i].as_py()))
                else:
                    rows.append((none, none) if lost[k + 1] > lost[k] else (own[0][k], own[1][k]))
                    k += 1
            a, b = (np.concatenate([none, *(r[side] for r in rows)]) for side in (0, 1))
            a_rows, b_rows = (np.concatenate([[0], np.cumsum([len(r[side]) for r in rows], dtype=np.int64)]) for side in (0, 1))
        return Tokens(a, b, a_rows, b_rows)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        a = self.a.library.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode([text])[0]
        if b"".join(map(self.b.bytes.__getitem__, b)) != b" " + text.encode():
            a = b = []
        return np.array(a, np.uint32), np.array(b, np.uint32)

    def digests(self, t: Tokens, links: Links) -> list[str]:
        """sha256 of `a1,a2|b1;a3|b2,b3` of every row; '' without tokens."""
        groups = len(links.a_cuts)
        if not groups:
            return [""] * (len(t.a_rows) - 1)
        a_size, b_size = (np.diff(cuts, prepend=-1) for cuts in (links.a_cuts, links.b_cuts))
        # An A token stands after all B tokens of earlier groups; a B token after all A tokens of its own and earlier ones.
        a_at = np.arange(len(t.a)) + np.repeat(links.b_cuts + 1 - b_size, a_size)
        b_at = np.arange(len(t.b)) + np.repeat(links.a_cuts + 1, b_size)
        which = np.empty(len(t.a) + len(t.b), np.int64)
        last_a, last_b = (np.zeros(n, bool) for n in (len(t.a), len(t.b)))
        last_a[links.a_cuts] = last_b[links.b_cuts] = True
        bases = np.cumsum([0, len(self.a_names[0]), len(self.a_names[1]), len(self.b_names[0])])
        which[a_at] = t.a + np.where(last_a, bases[1], bases[0])
        which[b_at] = t.b + np.where(last_b, bases[3], bases[2])
        _, places, data = self.names.take(pa.array(which)).buffers()
        places, data = np.frombuffer(places, np.int64), memoryview(data)
        rows = places[t.a_rows + t.b_rows]
        return [sha256_hex(data[x : y - 1]) if y > x else "" for x, y in zip(rows, rows[1:], strict=False)]

    @property
    def names(self) -> pa.Array:
        if not hasattr(self, "_names"):
            self._names = pa.concat_arrays([*self.a_names, *self.b_names])
        return self._names


def run_starts(t: Tokens, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first A and B token of every run: rows that have tokens, and parts of rows of more than ``RUN`` A tokens."""
    n = np.diff(t.a_rows)
    extra = np.maximum(n - 1, 0) // RUN
    row = np.repeat(np.arange(len(n)), extra)
    k = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    at, stop = t.a_rows[row] + k * RUN, t.a_rows[row + 1]
    done_a, done_b = [t.a_rows[:-1][n > 0]], [t.b_rows[:-1][n > 0]]
    for _ in range(TRIES):
        if not len(at):
            break
        end = a_ends[at - 1]
        there = np.searchsorted(b_ends, end)
        meets = b_ends[there] == end
        done_a.append(at[meets])
        done_b.append(there[meets] + 1)
        left = ~meets & (at + 1 < stop)
        at, stop = at[left] + 1, stop[left]
    a, b = np.concatenate(done_a), np.concatenate(done_b)
    order = np.argsort(a, kind="stable")
    first = np.concatenate([[True], a[order][1:] != a[order][:-1]]) if len(a) else np.zeros(0, bool)
    return a[order][first], b[order][first]


def lockstep(t: Tokens, a_ends: np.ndarray, b_ends: np.ndarray) -> Links:
    """All links and cuts of a part by one vector of pointers; the byte ends of its tokens run over all rows."""
    a, b = run_starts(t, a_ends, b_ends)
    stop = np.append(a[1:], len(t.a))
    links, cuts = [], []
    while len(a):
        a_end, b_end = a_ends[a], b_ends[b]
        links.append((a, b))
        both = a_end == b_end
        cuts.append((a[both], b[both]))
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    joined = lambda pairs, side: np.concatenate([np.zeros(0, np.int64), *(p[side] for p in pairs)])
    return Links(joined(links, 0), joined(links, 1), np.sort(joined(cuts, 0)), np.sort(joined(cuts, 1)))


_aligners: dict[tuple[str, str, str], Aligner] = {}


def aligner(paths: tuple[str, str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _aligned(batches, paths: tuple[str, str, str]) -> Iterator[tuple[pa.RecordBatch, Aligner, Tokens, Links]]:
    both = aligner(paths)
    for large in parts(batches, UNIT_BYTES):
        every, at = both.tokens(large.column(1)), 0
        for part in parts([large], PART_BYTES):
            t = every.rows(at, at + part.num_rows)
            at += part.num_rows
            yield part, both, t, lockstep(t, np.cumsum(both.a_sizes[t.a]), np.cumsum(both.b_sizes[t.b]))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def pair_counts(docs: DataFrame, paths: tuple[str, str, str], b_size: int) -> DataFrame:
    """Rows (pair, n): how many links hold A id * b_size + B id, over all texts."""

    def run(batches):
        keys, counts, held = [], [], 0
        for _, _, t, links in _aligned(batches, paths):
            key, n = np.unique(t.a[links.a].astype(np.int64) * b_size + t.b[links.b], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > TASK_PAIRS:
                key, n = _summed(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > TASK_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                    keys, counts, held = [], [], 0
        if held:
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return doc_texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, paths: tuple[str, str, str], hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text.

    paths: the byte-level vocabulary, its pattern, and the sentencepiece model. n_best counts links whose pair is as frequent in the
    corpus as any pair of their B id; count_sum adds the corpus counts of all links. ``hot_pairs`` bounds what is broadcast and
    changes no result.
    """
    import sentencepiece

    spark = docs.sparkSession
    b_size = sentencepiece.SentencePieceProcessor(model_file=paths[2]).get_piece_size()
    pairs = staged(pair_counts(docs, paths, b_size), "pairs").withColumn("b", F.col("pair") % b_size)
    # One row for each id of B: bounded by its vocabulary.
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))
    pairs = staged(pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), F.floor(F.log2("n") * 16).cast("int").alias("size")), "counts")
    total, floor = 0, None
    for r in pairs.groupBy("size").count().orderBy(F.desc("size")).collect():  # at most 16 sizes a power of two
        total += r["count"]
        if total > hot_pairs:
            floor = r["size"]
            break
    hot = (pairs if floor is None else pairs.where(F.col("size") > floor)).orderBy("pair").select("pair", "n", "best").toArrow()
    known = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        keys, counts, bests = known.value
        keys, counts, bests = np.append(keys, -1), np.append(counts, 0), np.append(bests, False)
        for part, both, t, links in _aligned(batches, paths):
            rows = part.num_rows
            of = np.searchsorted(t.a_rows, links.a, "right") - 1
            pair, back = np.unique(t.a[links.a].astype(np.int64) * b_size + t.b[links.b], return_inverse=True)
            at = np.minimum(np.searchsorted(keys[:-1], pair), max(len(keys) - 2, 0))
            met = keys[at] == pair
            n, best = np.where(met, counts[at], 0), np.where(met, bests[at], False)
            per_row = lambda w: np.bincount(of, w, rows)
            # Two halves of the counts, so that sums of doubles stay exact.
            high, low = (per_row(x[back].astype(float)).astype(np.int64) for x in (n >> 26, n & ((1 << 26) - 1)))
            rest = np.flatnonzero(~met[back])
            tail, tail_n = np.unique(of[rest] * np.int64(len(pair) + 1) + back[rest], return_counts=True)
            tail_of = tail // (len(pair) + 1)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(tail_of, minlength=rows))]).astype(np.int32)
            tails = pa.StructArray.from_arrays([pa.array(pair[tail % (len(pair) + 1)]), pa.array(tail_n)], names=["pair", "times"])
            groups = np.searchsorted(links.a_cuts, t.a_rows)
            columns = {
                "doc_id": part.column(0), "n_a": pa.array(np.diff(t.a_rows)), "n_b": pa.array(np.diff(t.b_rows)), "n_groups": pa.array(np.diff(groups)),
                "n_links": pa.array(np.bincount(of, minlength=rows)), "n_best": pa.array(per_row(best[back]).astype(np.int64)), "count_sum": pa.array((high << 26) + low),
                "groups_sha256": pa.array(both.digests(t, links), pa.string()), "tail": pa.ListArray.from_arrays(pa.array(offsets), tails),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    scored = doc_texts(docs).mapInArrow(run, names + ", tail array<struct<pair: bigint, times: bigint>>")
    if floor is None:
        return scored.drop("tail")
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    cold = scored.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.times").join(pairs.where(F.col("size") <= floor), "pair")
    added = cold.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.col("times")).alias("sum"))
    extra = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return scored.join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", extra("n_best", F.col("more")), extra("count_sum", F.col("sum")), "groups_sha256")


def op13(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return align(docs, (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")))
