"""Byte-level BPE by a pair occurrence index: every pair of symbols points to all its places, and ranks are applied in ascending order.

The pieces of the pre-tokenizer's pattern that a worker meets for the first time in a part of its partition are laid out as one
array of byte symbols. The index maps the rank of each adjacent pair to all places where it stands. The lowest active rank is
taken; it merges at all its places at once (of overlapping places in a run of one symbol every second one, from the left), and
only the lists of the pairs that the merged symbols form with their neighbours are changed. A merge always has a higher rank than
the merges that make its parts (checked when the vocabulary is read), so ascending ranks give each piece what it gets alone.

Defined results, as the tokenizers library with its defaults: null text encodes as empty; a string of an added token inside a text
becomes that token's id; every input row gives one output row, repeated rows and null doc_ids included; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import _RUNS, DIGEST_BYTES, KNOWN_UNITS, ByteBpe, byte_characters
from .common import doc_texts, parts, sha256_hex


#: Bytes of text whose new pieces share one index (one text at least).
INDEX_BYTES = 4 << 20


class Merges:
    """The merges of a vocabulary: base symbol of each byte, and rank and result of a pair of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, stand_in = model["vocab"], byte_characters()
        self.base = np.array([vocabulary[stand_in[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocabulary.values()) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge stands before the merges of its parts")
        self.size = len(born)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys)
        self.keys, self.order = np.append(keys[self.order], self.size**2), np.append(self.order, -1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        wanted = left * self.size + right
        at = self.keys.searchsorted(wanted)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


class PairIndex:
    """Places of all pairs of adjacent symbols, by rank."""

    def __init__(self, merges: Merges, symbols: np.ndarray, piece_ends: np.ndarray):
        #: One more place, ``end``, stands before the first and after the last symbol of every piece.
        self.end = n = len(symbols)
        self.merges, self.symbols = merges, np.append(symbols, -1)
        self.after = np.arange(1, n + 2)
        self.after[piece_ends[piece_ends > 0] - 1] = n
        self.after[n] = n
        self.before = np.full(n + 1, n)
        inner = np.flatnonzero(self.after < n)
        self.before[self.after[inner]] = inner
        self.stamp = np.full(n + 1, -1)
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(inner)

    def add(self, at: np.ndarray) -> None:
        """Enter the pairs that start at these places into their lists."""
        ranks = self.merges.ranks(self.symbols[at], self.symbols[self.after[at]])
        merging = (ranks >= 0).nonzero()[0]
        if not merging.size:
            return
        ranks = ranks[merging]
        order = ranks.argsort(kind="stable")
        at, ranks = at[merging[order]], ranks[order]
        cuts = (ranks[1:] != ranks[:-1]).nonzero()[0].tolist()
        start = 0
        for stop in [*(c + 1 for c in cuts), ranks.size]:
            rank = int(ranks[start])
            if rank in self.places:
                self.places[rank].append(at[start:stop])
            else:
                self.places[rank] = [at[start:stop]]
                heapq.heappush(self.active, rank)
            start = stop

    def apply(self, rank: int, at: np.ndarray) -> None:
        """Merge one rank at all of its places that still hold its pair."""
        left, right = self.merges.left[rank], self.merges.right[rank]
        gone = self.after[at]
        # The symbol after the last one of a piece, and that of a place that is gone, is -1.
        held = ((self.symbols[at] == left) & (self.symbols[gone] == right)).nonzero()[0]
        if not held.size:
            return
        at = at[held]
        if left == right and len(at) > 1:
            at = np.unique(at)
            first = np.concatenate([[True], at[1:] != self.after[at[:-1]]])
            starts = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - starts[np.cumsum(first) - 1]) % 2 == 0]
        gone = self.after[at]
        beyond = self.after[gone]
        self.symbols[at] = self.merges.made[rank]
        self.symbols[gone] = -1
        self.after[at] = beyond
        self.before[beyond] = at
        self.stamp[at] = rank
        ahead = self.before[at]
        # A place that merged too stands for itself already.
        changed = np.concatenate([at[beyond < self.end], ahead[(ahead < self.end) & (self.stamp[ahead] != rank)]])
        if changed.size:
            self.add(changed)

    def run(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.places.pop(rank)
            self.apply(rank, lists[0] if len(lists) == 1 else np.concatenate(lists))


class PairIndexBpe(ByteBpe):
    """The byte-level codec with the pair occurrence index in place of the library's model."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        self.merges, self.pattern = Merges(path), regex.compile(pattern)
        added = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.added = added
        self.token_bytes += [b""] * (max([len(self.token_bytes) - 1, *added.values()]) + 1 - len(self.token_bytes))
        for content, k in added.items():
            self.token_bytes[k] = content.encode()
        self.commas = pa.array([b"%d," % k for k in range(len(self.token_bytes))], pa.large_binary())
        self.byte_table = pa.array(self.token_bytes, pa.large_binary())
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _tokenize(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the pair occurrence index over all of them."""
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer("".join(pieces.to_pylist()).encode(), np.uint8)
        index = PairIndex(self.merges, self.merges.base[data], ends)
        index.run()
        alive = index.symbols[:-1] >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return index.symbols[:-1][alive].astype(np.uint32), kept[ends] - kept[ends - lengths]

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text with runs of white space or strings of added tokens."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.array([self.added[part]], np.uint32))
            elif part:
                words = pa.array(self.pattern.findall(part), pa.large_string()).dictionary_encode()
                slots = self.pieces.slots(words.dictionary, self._tokenize)[words.indices.to_numpy()]
                out.append(self.pieces.ids(self.pieces.starts[slots], self.pieces.counts[slots]))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_part(self, texts: pa.Array, known_units: int = KNOWN_UNITS) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of rows in ids) of a string column."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        for content in self.added:
            apart = apart | pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._cut(texts, known_units)
        ids, offsets = self._cut(pc.filter(texts, pa.array(~apart)), known_units)
        plain = iter(np.split(ids, offsets[1:-1]) if len(offsets) > 1 else [])
        rows = [self._whole(texts[k].as_py()) if odd else next(plain) for k, odd in enumerate(apart)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_codecs: dict[tuple[str, str], PairIndexBpe] = {}


def codec(path: str, pattern: str) -> PairIndexBpe:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = PairIndexBpe(path, pattern)
    return _codecs[path, pattern]


def _encoded(batches, path: str, pattern: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, PairIndexBpe]]:
    """Parts of ``DIGEST_BYTES`` with ids and offsets; the index is made over ``INDEX_BYTES`` of text at a time."""
    bpe = codec(path, pattern)
    for large in parts(batches, INDEX_BYTES):
        ids, offsets = bpe.encode_part(large.column(1))
        at = 0
        for part in parts([large], DIGEST_BYTES):
            own = offsets[at : at + part.num_rows + 1]
            yield part, ids[own[0] : own[-1]], own - own[0], bpe
            at += part.num_rows


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids): token ids of every whole text."""

    def run(batches):
        for part, ids, offsets, _ in _encoded(batches, path, pattern):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text) from rows with doc_id and ids; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes its ids."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part, ids, offsets, bpe in _encoded(batches, path, pattern):
            written, _, lines = bpe.spelled(bpe.commas, ids, offsets)
            data, _, rows = bpe.spelled(bpe.byte_table, ids, offsets)
            columns = [
                part.column(0),
                pa.array(np.diff(offsets)),
                pa.array([sha(written[a : max(a, b - 1)]) for a, b in zip(lines, lines[1:], strict=False)], pa.string()),
                pa.array([sha256_hex(str(data[a:b], "utf-8", "replace").encode()) for a, b in zip(rows, rows[1:], strict=False)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
