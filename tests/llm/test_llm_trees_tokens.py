"""Pair-index BPE, Merkle manifest and token alignment against plain versions, with hard cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapanel.llm import merkle_manifest, pair_index_bpe, token_alignment
from terrapanel.llm.bpe import byte_characters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "a", "aaaa" * 50, "é" * 70, "\n\n  \t", "😀 a  b c\r\nd", "it's we'll 12 345,6", "<|endoftext|> x <s></s>", "a<|endoftext|><|endoftext|>b  <|endoftext|>",
    "a▁b c", "▁", "\x00 a", "x y", "abc ", "abc\n", " a b", "    " * 9 + "z", "你好世界 東京", "a\nb\nc d", "\nabc", "abc\n\ndef", "word " * 800, "ﬁ é", "x" * 3000, "word",
]


def texts(n=150, seed=1):
    rng = random.Random(seed)
    bits = ["a", "b", "aa", " ", "\n", "é", "1", "'s", ".", "ß", "你", "x", " the ", "ing"]
    return HARD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)] + ["a b", "a b"]


def frame(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "key": F.lit("clash"), "row": F.lit(0), "pair": F.lit(1), "tail": F.lit("t"), "a.b": F.lit(1), "x`y": F.lit(2)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pair_index_equals_library(spark):
    library = Tokenizer.from_file(A)
    got = {r["doc_id"]: r for r in pair_index_bpe.op11(frame(spark, texts())).collect()}
    for k, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids)))), t
        assert got[k]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False)), t
    docs = frame(spark, texts(20))
    back = pair_index_bpe.decode(pair_index_bpe.encode(docs, A, P.PATTERN), A, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in enumerate(texts(20))}
    broken = spark.createDataFrame([(1, [19526]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pair_index_bpe.decode(broken, A, P.PATTERN).collect()} == {1: library.decode([19526]), 2: ""}
    assert pair_index_bpe.op11(docs.limit(0)).count() == 0


def test_pair_index_merges_runs_from_the_left():
    merges = pair_index_bpe.codec(A, P.PATTERN).merges
    library = Tokenizer.from_file(A)
    pieces = ["aaaaaaa", "abababab", "hahahaha", "lllllllll", "", "ssssss", "z" * 257]
    data = np.frombuffer("".join(pieces).encode(), np.uint8)
    index = pair_index_bpe.PairIndex(merges, merges.base[data], np.cumsum([len(x) for x in pieces]))
    index.run()
    want = [k for x in pieces for k in library.encode(x).ids]
    assert [k for k in index.symbols.tolist() if k >= 0] == want


def plain_tree(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1]))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in langs[x]]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for g, x in enumerate(names):
        for i, r in enumerate(langs[x]):
            proof, hit = "", r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, 1 if hit else 0)
            for tree, at in ((trees[x], i), (top, g)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    fold = sha(other + fold if at % 2 else fold + other)
                    proof, at = proof + other, at // 2
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def known_first(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("width", [2, 6])
def test_merkle_manifest_equals_plain_tree(spark, monkeypatch, width):
    monkeypatch.setattr(merkle_manifest, "WIDTH", width)
    rng = random.Random(3)
    pick = rng.choice
    rows = [(pick([None, 1, 2, rng.randrange(1000)]), pick([None, "", "é x", "word"]), pick(["en", "en", "en", "", None, "ü", "z"]), pick([None, "s"]), pick([None, 3])) for _ in range(170)]
    rows += [(7, "a", "solo", "s", 1)] + rows[:5]
    for part in (rows, rows[:1], rows[:3], []):
        df = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        df = df.withColumns({"key": F.lit("x"), "lo": F.lit(9), "n": F.lit(1), "a.b": F.lit(1)})
        assert known_first(merkle_manifest.op12(df).select(*COLUMNS).collect()) == known_first(plain_tree(part))


def test_merkle_sql_equals_plain_tree():
    import duckdb

    rng = random.Random(4)
    pick = rng.choice
    rows = [(pick([None, 1, 2, rng.randrange(1000)]), pick([None, "", "é x"]), pick(["en", "en", None, "ü", "z"]), pick([None, "s"]), pick([None, 3])) for _ in range(90)] + [(7, "a", "solo", "s", 1)]
    for part in (rows, rows[:1], rows[:3]):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", part)
        assert known_first(con.execute(merkle_manifest.SQL).fetchall()) == known_first(plain_tree(part))


def test_merkle_links_are_nested_intervals(spark):
    base = spark.createDataFrame([("k", 11, i, i + 1, sha(str(i))) for i in range(11)], "key string, n long, lo long, hi long, digest string")
    rows = merkle_manifest.climb(base, 0, 4).collect()
    assert [(r["lo"], r["hi"]) for r in rows] == [(0, 11)]
    nodes = {(x["level"], x["lo"]): x for x in rows[0]["links"]}
    assert nodes[3, 8]["hi"] == 11 and nodes[0, 10]["sibling"] == "" and nodes[2, 8]["sibling"] == ""
    assert nodes[1, 8]["sibling"] == nodes[1, 10]["digest"] and nodes[1, 8]["after"] and not nodes[1, 10]["after"]


def plain_alignment(texts):
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    back = {c: b for b, c in byte_characters().items()}
    a_bytes = {k: bytes(back[c] for c in t) for t, k in a_model.get_vocab(with_added_tokens=False).items()}
    b_bytes = lambda k: bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode()
    docs = []
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        if t and not (b"".join(map(a_bytes.get, a)) == b"".join(map(b_bytes, b)) == b" " + t.encode()):
            a, b = [], []
        ranges = []
        for ids, of in ((a, a_bytes.get), (b, b_bytes)):
            ends = np.cumsum([len(of(k)) for k in ids]).tolist()
            ranges.append(list(zip([0, *ends], ends)))
        links, j = [], 0
        for i, (low, high) in enumerate(ranges[0]):
            while ranges[1][j][1] <= low:
                j += 1
            links += [(a[i], b[k]) for k in range(j, len(b)) if ranges[1][k][0] < high] if len(b) < 500 else [(a[i], b[k]) for k in range(j, min(len(b), j + 300)) if ranges[1][k][0] < high]
        cuts = sorted({h for _, h in ranges[0]} & {h for _, h in ranges[1]})
        ids = lambda side, ids, low, high: ",".join(str(k) for k, (x, y) in zip(ids, ranges[side]) if low <= x and y <= high)
        groups = ";".join(f"{ids(0, a, low, high)}|{ids(1, b, low, high)}" for low, high in zip([0, *cuts], cuts))
        docs.append((len(a), len(b), len(cuts), links, sha(groups) if a else ""))
    counts, most = Counter(x for d in docs for x in d[3]), Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d[0], d[1], d[2], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_alignment_equals_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "RUN", 64)
    want = plain_alignment(texts())
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.align(frame(spark, texts()), (A, P.PATTERN, B), hot).collect()}
    for k, t in enumerate(texts()):
        assert got[k] == want[k], t
    assert token_alignment.op13(frame(spark, texts()).limit(0)).count() == 0
