"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A single blank or line feed between two characters that aren't white space always starts a new match of the pre-tokenizer's
pattern, so texts are cut there into units; the different units of a part of a batch are found by Arrow. Only units that the
worker doesn't know yet are cut into the pattern's matches, and only matches it doesn't know are mapped byte by byte to the
vocabulary's characters and handed to the library's BPE model. What is known is kept as Arrow strings with their ids in one
array, up to a bound. Texts with other runs of white space are encoded whole by the library. Decoding reverses the byte table; a token may end inside a character, so offsets
come from the byte positions of tokens and the number of characters that start before them.

Defined results: null text encodes as empty (no ids); special-token strings are ordinary text; every input row gives
one output row, repeated rows and null doc_ids included; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import doc_texts

#: Units, and pieces of units, that a worker keeps; beyond them it starts anew.
KNOWN_UNITS = 250_000
#: Bytes of text that are encoded at a time (one text at least).
PART_BYTES = 2 << 20
#: The same where ids, spelled ids and character offsets of a part are held together.
DIGEST_BYTES = 1 << 20
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that the unit cut doesn't fit: white space at the start or beside other white space.
_RUNS = f"^{_SPACE}|{_SPACE}{_SPACE}"


def byte_characters() -> dict[int, str]:
    """The byte-level vocabulary's printable stand-in for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Known:
    """Strings met so far and their ids: Arrow strings, and places in one array of ids."""

    def __init__(self):
        self.strings, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def slots(self, wanted: pa.Array, make) -> np.ndarray:
        """Place of each of these different strings; make(strings) gives (ids, counts) of those met for the first time."""
        found = pc.index_in(wanted, value_set=self.strings)
        fresh = pc.is_null(found).to_numpy(zero_copy_only=False)
        slots = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        if fresh.any():
            missing = pc.filter(wanted, pa.array(fresh))
            ids, counts = make(missing)
            slots = slots.copy()
            slots[fresh] = len(self.strings) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(counts) - counts).astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.pool, self.strings = np.concatenate([self.pool, ids]), pa.concat_arrays([self.strings, missing])
        return slots

    def ids(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of runs of the pool, one after another."""
        ends = np.cumsum(counts, dtype=np.int32)
        take = np.repeat(starts - (ends - counts), counts)
        take += np.arange(len(take), dtype=np.int32)
        return self.pool[take]


class ByteBpe:
    """Encoder and decoder of one vocabulary file; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.model = self.library.model
        # Inside a unit no run of white space can follow itself, so that Arrow's engine needs no lookahead.
        self.piece = pattern.replace(r"|\s+(?!\S)", "").replace(r"\s+", r"\s").replace(r"\s", _SPACE).replace("[^" + _SPACE, "[^" + _SPACE[1:-1])
        stand_in = byte_characters()
        back = {c: b for b, c in stand_in.items()}
        #: Byte to character, but for the line feed, which parts pieces here.
        self.characters = "".join("\n" if b == 10 else stand_in[b] for b in range(256))
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.token_bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.decimals = pa.array([b"%d " % k for k in range(len(self.token_bytes))], pa.large_binary())
        self.byte_table = pa.array(self.token_bytes, pa.large_binary())
        self.inside = np.array([t[:1] >= b"\x80" and t[:1] < b"\xc0" for t in self.token_bytes])
        self.feed = np.array([t.id for t in self.model.tokenize(stand_in[10])], np.uint32)
        if len(self.feed) != 1:
            raise ValueError("the vocabulary must have a line feed as one token")
        self.units, self.pieces = Known(), Known()

    def _tokenize(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, which hold no line feed unless they are one, by the library's model."""
        ids, counts, tokenize = [], [], self.model.tokenize
        for at in range(0, len(pieces), 8192):
            text, _ = codecs.charmap_decode("\n".join(pieces.slice(at, 8192).to_pylist()).encode(), "strict", self.characters)
            some: list[int] = []
            for piece in text.split("\n"):
                tokens = tokenize(piece)
                some += [t.id for t in tokens]
                counts.append(len(tokens))
            ids.append(np.array(some, np.uint32))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _cut_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: each is cut into the pattern's matches; one that a line feed leads has its id in front."""
        fed = pc.starts_with(units, "\n")
        empty = pa.scalar("", pa.large_string())
        body = pc.if_else(fed, pc.utf8_slice_codeunits(units, 1), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, empty))
        cut = pc.split_pattern(pc.replace_substring_regex(body, self.piece, "\n\\0"), "\n")
        places, words = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        slots = self.pieces.slots(words.dictionary, self._tokenize)[words.indices.to_numpy()]
        starts, counts = self.pieces.starts[slots], self.pieces.counts[slots]
        ids, lead = self.pieces.ids(starts, counts), fed.to_numpy(zero_copy_only=False)
        per_unit = np.diff(np.concatenate([[0], np.cumsum(counts)])[places])
        at = (np.cumsum(per_unit) - per_unit)[lead]
        return np.insert(ids, at, self.feed[0]), per_unit + lead

    def _slots(self, units: pa.Array, known_units: int) -> np.ndarray:
        if len(self.units.strings) > known_units:
            self.units = Known()
        if len(self.pieces.strings) > known_units:
            self.pieces = Known()
        return self.units.slots(units, self._cut_units)

    def _cut(self, texts: pa.Array, known_units: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts without runs of white space. A line feed put before each text leaves with its first id."""
        led = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(led, " ")
        places = cut.offsets.to_numpy().astype(np.int64)
        words = cut.flatten().dictionary_encode()
        slots = self._slots(words.dictionary, known_units)[words.indices.to_numpy()]
        starts, counts = self.units.starts[slots], self.units.counts[slots]
        first = places[:-1]
        starts[first] += 1
        counts[first] -= 1
        return self.units.ids(starts, counts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[places]

    def encode_parts(self, texts: pa.Array, known_units: int = KNOWN_UNITS, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of rows in ids) of a string column, in order, about ``part_bytes`` of text at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, base + part_bytes, "right")))
            part = texts.slice(at, stop - at)
            runs = pc.match_substring_regex(part, _RUNS).to_numpy(zero_copy_only=False)
            if not runs.any():
                yield at, *self._cut(part, known_units)
            else:
                ids, offsets = self._cut(pc.filter(part, pa.array(~runs)), known_units)
                plain = iter(np.split(ids, offsets[1:-1]) if len(offsets) > 1 else [])
                rows = [
                    np.array(self.library.encode(part[k].as_py(), add_special_tokens=False).ids, np.uint32) if run else next(plain)
                    for k, run in enumerate(runs)
                ]
                yield at, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            at = stop
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(ids.astype("<u4").tobytes() for _, ids, _ in self.encode_parts(pa.array([text], pa.string())))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def spelled(self, table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """(entries of a table for all ids, joined; place of each and of the end; places of the rows)."""
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        _, places, data = table.take(pa.array(ids)).buffers()
        places = np.frombuffer(places, np.int64)[: len(ids) + 1]
        return memoryview(data), places, places[offsets]

    @staticmethod
    def offsets(data: memoryview, places: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end of each token in its text; a split character belongs to each of its tokens."""
        lead = (np.frombuffer(data, np.uint8)[: places[-1]] & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        own = np.repeat(before[rows[:-1]], np.diff(offsets))
        split = ~lead[places[:-1]] if len(lead) else np.zeros(len(places) - 1, bool)
        return (before[places[:-1]] - split - own).astype(np.int32), (before[places[1:]] - own).astype(np.int32)


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(path, pattern)
    return _codecs[path, pattern]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids, starts, ends): token ids and character offsets of every whole text."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at, ids, offsets in bpe.encode_parts(batch.column(1)):
                starts, ends = bpe.offsets(*bpe.spelled(bpe.byte_table, ids, offsets), offsets)
                arrays = [batch.column(0).slice(at, len(offsets) - 1), *(_lists(x, offsets) for x in (ids, starts, ends))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "starts", "ends"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text) from rows with doc_id and ids; the joined bytes are read as UTF-8 once, at the end."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, known_units: int = KNOWN_UNITS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_sha256[, ids]): encodes and decodes every whole text.

    n_split counts tokens that start inside a character; offsets_sha256 is of the character starts, then ends, as little-endian
    32-bit integers. ``known_units`` bounds the units that a worker remembers; it changes memory and speed only.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_sha256"] + ["ids"] * with_ids

    def run(batches):
        bpe = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at, ids, offsets in bpe.encode_parts(batch.column(1), known_units, DIGEST_BYTES):
                n = len(offsets) - 1
                written, _, lines = bpe.spelled(bpe.decimals, ids, offsets)
                data, places, rows = bpe.spelled(bpe.byte_table, ids, offsets)
                starts, ends = (x.astype("<i4", copy=False) for x in bpe.offsets(data, places, rows, offsets))
                inside = np.concatenate([[0], np.cumsum(bpe.inside[ids], dtype=np.int64)])
                columns = [
                    pa.array(np.diff(offsets)),
                    pa.array([sha(written[a : max(a, b - 1)]) for a, b in zip(lines, lines[1:], strict=False)], pa.string()),
                    pa.array([sha(data[rows[k] : rows[k + 1]]) for k in range(n)], pa.string()),
                    pa.array(np.diff(inside[offsets])),
                    pa.array([sha(starts[a:b].tobytes() + ends[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string()),
                ] + [_lists(ids, offsets)] * with_ids
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], names=["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string"
    return doc_texts(docs).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def same_ranks(path: str, ranks_path: str, pattern: str) -> bool:
    """Whether a vocabulary file and a file of ranks give every token the same id."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return all(rank < len(codec(path, pattern).token_bytes) and codec(path, pattern).token_bytes[rank] == token for token, rank in ranks.items())


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    if not same_ranks(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern):
        raise ValueError("the two files of the vocabulary differ")
    return digest(docs, path, pattern)
