"""Word, token, media and score operators against plain versions, with hard cases: nulls, empty and long texts, ties."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import bpe, decontamination, license_scan, media_audio, pii, quality, secret_scan, sst_output

WORDS = ["alpha", "Beta", "gámma", "δέλτα", "x1", "the", "of", "and", "zz", "q"]


def texts(n=40, seed=5):
    rng = random.Random(seed)
    out = [None, "", " ", "a", "é" * 70, "\n\n  \t", "word " * 4000, "😀 a  b c\r\nd", "it's we'll 12 345,6", "<|endoftext|> x"]
    for _ in range(n):
        out.append(rng.choice([" ", "\n", ", "]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 120))))
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "k": F.lit("clash"), "row": F.lit(0), "base": F.lit(None), "spans": F.lit("s"), "source": F.concat(F.lit("s"), F.col("doc_id") % 4), "lang": F.lit("en")}) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [line(n) for n in (30, 12, 10, 9, 3, 1)] + ["", None, "..."]
    body = [line(60) + " " + rng.choice([i for i in items if i]) + "! " + line(20) for _ in range(30)] + [None, "", "x"]
    bench = spark.createDataFrame([(k * 7, t) for k, t in enumerate(items)] + [(None, "alpha")], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in enumerate(items):
        w = split(t)
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + min(10, len(w))]), set()).add(str(k * 7))
    for block in (1 << 20, 40):
        got = {r["doc_id"]: r for r in decontamination.decontaminate(frame(spark, body), bench, block_bytes=block).collect()}
        for k, t in enumerate(body):
            w, hit, found = split(t), set(), set()
            for size in {len(x) for x in windows}:
                for s in range(len(w) - size + 1):
                    if owners := windows.get(tuple(w[s : s + size])):
                        hit |= set(range(s, s + size))
                        found |= owners
            assert (got[k]["n_words"], got[k]["n_hit"], got[k]["item_ids"]) == (len(w), len(hit), sorted(found))
    empty = decontamination.op3(frame(spark, body), bench.limit(0))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(body)


def test_bpe_equals_tiktoken_and_round_trips(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.op4(docs).collect()}
    for k, t in enumerate(texts()):
        ids = plain.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts()))
    rng = random.Random(8)
    parts = [" ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "É", "1", "'s", "'ll", ".", "…", "😀", "\x00", "\r", "<|endoftext|>", "word", "\u0301"]
    hard = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    codec = bpe.ByteBpe(P.path("byte_bpe_50k.json"), P.PATTERN)
    for known in (1 << 20, 0):
        ids = [x[a:b].tolist() for _, x, o in codec.encode_parts(pa.array(hard), known) for a, b in zip(o, o[1:], strict=False)]
        assert ids == [plain.encode_ordinary(t) for t in hard]
    assert bpe.op4(docs.limit(0)).count() == 0 and not bpe.same_ranks(P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    smile = encoded.where("doc_id = 7").first()
    assert smile["starts"][0] == 0 and smile["ends"][-1] == len(texts()[7]) and smile["ends"][0] <= 1


def test_sst_round_trip_and_lookup(spark, docs):
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.json"), P.PATTERN
    out = f"{spark.conf.get('spark.checkpoint.dir')}/sst-test"
    sst_output.write_shards(docs.unionByName(docs.where("doc_id = 12")), out, path, pattern, block_bytes=256)
    rows = sorted(sst_output.read_shards(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([*range(len(texts())), 12])
    at, codec = 0, bpe.ByteBpe(path, pattern)
    for r in rows:
        ids = codec.encode(texts()[r["doc_id"]]) + struct.pack("<I", 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(sst_output.lookup(spark, out, 12)) == 2 and sst_output.lookup(spark, out, 10_000) == []
    assert sst_output.lookup(spark, out, 3)[0].astype("<u4").tobytes() == codec.encode("a") + struct.pack("<I", 0)
    shard = sst_output.read_sections(spark, out).where("section = 'footer'").orderBy("shard").first()
    sst_output.export_shard(spark, out, shard["shard"], f"{out}-file")
    with open(f"{out}-file".removeprefix("file:").replace("//", "/"), "rb") as f:
        data = f.read()
    foot = sst_output.read_footer(data[-len(shard["data"]) :])
    assert len(data) == foot["filter_at"] + foot["filter_size"] + len(shard["data"]) and foot["first"] == sst_output.key_of(0)
    assert next(sst_output.read_block(data[: int.from_bytes(data[foot["index_at"] + 16 : foot["index_at"] + 20], "little")]))[0] == foot["first"]
    same = spark.createDataFrame([(None, f"t {k}") for k in range(40)] + [(3, "x")], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sst_output.write_shards(same, out + "-null", path, pattern)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sst_output.read_sections(spark, out + "-null").where("section = 'footer'").count() > 1
    assert sorted(r["start"] for r in sst_output.read_shards(spark, out + "-null").where("doc_id is null").collect())[0] == 0
    with pytest.raises(ValueError):
        list(sst_output.read_block(sst_output.pack_block([(b"k", np.array([1, 2]))], 0, 2)[:-1] + b"\0"))
    sst_output.write_shards(docs.limit(0), out + "-none", path, pattern)
    assert sst_output.read_shards(spark, out + "-none").count() == 0


def test_mpeg_round_trip_and_damage(spark, docs):
    for r in media_audio.op7(docs).collect():
        data = (texts()[r["doc_id"]] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        frames = len(r["seek_offsets"])
        assert r["durations"] == f"{frames * 1152}/48000" and f"frames={frames};" in r["feature"]
        assert r["duration_us"] % 24000 == 0 and "resyncs=0" in r["feature"]
    stream = media_audio.wrap(bytes(range(256)) * 40, {"payload_bytes": "10240"})
    whole = media_audio.parse(stream)
    assert whole["declared"] == len(whole["offsets"]) == 11 and whole["bad_crc"] == 0
    assert whole["duration_us"] == 11 * 24000 and whole["data"][:10240] == bytes(range(256)) * 40
    at = whole["offsets"][3]
    assert media_audio.parse(stream[: at + 8] + b"\x55" + stream[at + 9 :])["bad_crc"] == 1
    torn = media_audio.parse(stream[:at] + b"garbage" + stream[at:])
    assert torn["resyncs"] == 1 and len(torn["offsets"]) == 11
    assert media_audio.parse(b"")["offsets"] == [] and media_audio.parse(b"\xff" * 50)["offsets"] == []


def test_quality_separates_and_has_defined_edges(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(WORDS[:8]) for _ in range(rng.randrange(20, 200))) + "." for _ in range(120)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randrange(20, 200))) for _ in range(60)]
    rows = good + bad + [None, ""]
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.op8(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [k for k in range(180) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] for k in held)
    assert sum(got[k]["predicted"] == int(k < 120) for k in held) >= 0.95 * len(held)
    none = quality.op8(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.op8(frame(spark, rows[:3]).limit(0), labels).count() == 0
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id between 120 and 179").count() <= 3


def test_license_labels(spark):
    rows = [
        "x y Released under the MIT License. tail", "Licensed under the Apache License, Version 2.0.", "mit license mit license", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "by nc 4 0 cc under", "plain words only",
    ] + ["filler words here"] * 40
    got = {r["doc_id"]: r for r in license_scan.op9(frame(spark, rows)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["labels"]) == (1, 5, "mit")
    assert got[2]["n_base"] == 2 and (got[2]["first_word"], got[2]["last_word"]) == (0, 2)
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["score"] == 0.0
    assert got[5]["base_labels"] == "gpl" and got[6]["labels"] == "cc-by-nc" and got[6]["base_labels"] == ""
    assert got[7]["labels"] == "" and got[1]["score"] == pytest.approx(1.0)
    assert license_scan.op9(frame(spark, rows).limit(0)).count() == 0


def test_secret_spans_and_ownership(spark):
    token = "Ab3" + "dE5fG7hI9" * 4
    live = "password = 'Qx7_kd93Lm2pTz8v'"
    rows = [live, "api_key: " + "0123456789abcdef" * 2, "AKIA" + "Z9Y8" * 5, "token=abc secret:longenough", None, "", "é token='" + token + "'", "see " + token]
    rows += ["token = copied_Example_1234567"] * 6
    got = {r["doc_id"]: r for r in secret_scan.op1(frame(spark, rows)).collect()}
    assert got[0]["spans"] == f"assign:0:{len(live) - 1}" and got[0]["n_live"] == 1
    assert (got[1]["n_assign"], got[1]["n_hex"]) == (1, 1) and got[2]["n_access"] == 1
    assert got[3]["n_assign"] == 1 and got[3]["spans"] == "assign:10:27"
    assert got[4]["base_sha256"] == got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["spans"].startswith("assign:2:") and got[7]["spans"] == f"token:4:{4 + len(token)}"
    assert all(got[k]["n_copied"] == 1 and got[k]["n_live"] == 0 for k in range(8, 14))
    assert secret_scan.op1(frame(spark, rows).limit(0)).count() == 0


def test_secret_values_by_owners_and_repositories(spark):
    """Planted: a key of one owner, one that three owners share, one of one owner in many repositories, and a hot example."""
    token = lambda x: (x + "q7W2e9R4t6Y1u8I3") * 2
    plan = [("own", "a", ["r1", "r2"]), ("three", "abc", ["r"]), ("many", "d", [f"r{k}" for k in range(9)]), ("hot", "abcdef", ["r"] * 60)]
    rows = [(None if name == "own" else k, f"x {token(name)} y", o, f"{o}/{r}") for k, (name, owners, repos) in enumerate(plan) for o in owners for r in repos]
    docs = spark.createDataFrame(rows, "doc_id long, text string, team string, repo string")
    got = secret_scan.scan(docs, F.col("team"), F.col("repo")).select("doc_id", F.size("live").alias("n"), "n_copied", F.size("spans").alias("s"), "most_repositories").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n"], r["n_copied"], r["s"], r["most_repositories"]) for r in got}
    assert by == {None: (1, 0, 1, 2), 1: (0, 1, 0, 3), 2: (0, 1, 0, 9), 3: (0, 1, 0, 6)}


def test_base_spans_equal_plain_code_on_hard_texts(spark):
    rng = random.Random(12)
    parts = ["password", " = ", ":", "'", '"', "aB3dE5fG", "AKIA", "Z9" * 9, "0123456789abcdef" * 2, " ", "é", "😀", "@", ".", "a.b", "1.2.3.4", "+1 499 555 6503", "4111 1111 1111 1111", "-", "9" * 17]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + [None, ""]
    find = lambda name, k, p, t, ok=lambda m: True: [(name, m.start(), m.end(), k) for m in re.finditer(p, t) if ok(m)]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    secret, private = {}, {}
    for k, t in enumerate(rows):
        t = t or ""
        assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        s = find("assign", 0, assign, t, lambda m: len(m[1]) >= 6) + find("access", 1, "AKIA[A-Z0-9]+", t, lambda m: len(m[0]) >= 20)
        secret[k] = sorted(s + find("hex", 2, "[0-9a-f]+", t, lambda m: len(m[0]) >= 24), key=lambda x: (x[1], x[3]))
        p = find("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        p += find("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(x) <= 255 for x in m[0].split(".")))
        p += find("card", 2, r"[0-9]([\x20-]?[0-9])+", t, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)))
        private[k] = p + find("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 8 <= len(digits(m)) <= 15)
    docs = frame(spark, rows)
    for got, want in ((secret_scan.op1(docs), secret), (pii.op2(docs), private)):
        for r in got.select("doc_id", "base_sha256").collect():
            line = ",".join(f"{n}:{a}:{b}" for n, a, b, _ in want[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), rows[r["doc_id"]]


def test_pii_spans_terms_and_redaction(spark):
    plain = ["ordinary words with common meaning here"] * 30
    secret = ["contact Jonquilla at j.q@mail.example.com about meaning"] * 4
    rows = ["card 4111 1111 1111 1111 and 1.2.3.4, 300.1.1.1", "+1 (499) 555-6503", "a@b.c_d@e.f", None, "", "9" * 5000, "x" * 20000 + "@"] + secret + plain
    got = {r["doc_id"]: r for r in pii.op2(frame(spark, rows)).collect()}
    assert got[0]["spans"] == "ip:29:36,card:5:24" and got[1]["n_phone"] == 1 and got[2]["n_email"] == 2
    assert got[3]["spans"] == got[4]["spans"] == got[5]["spans"] == got[6]["spans"] == ""
    assert "remove:8:17" in got[7]["spans"] and "remove:48:" not in got[7]["spans"] and got[7]["n_email"] == 1
    assert all(got[k]["spans"] == "" for k in range(11, 41))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[7] == "<REMOVED> <REMOVED> at <EMAIL> <REMOVED> meaning" and "@" not in clean[7] and clean[3] is None and clean[12] == plain[0]
    assert clean[0] == "card <CARD> and <IP>, 300.1.1.1"
    assert pii.op2(frame(spark, rows).limit(0)).count() == 0


def test_pii_scores_entities_of_one_or_two_documents(spark):
    plain = ["ordinary words with common meaning here"] * 2040
    rows = ["Jonquilla common j.q@mail.example.com"] + ["Marwick common +1 499 555 6503"] * 2 + ["Marwick common"] + plain
    got = {r["doc_id"]: r for r in pii.op2(frame(spark, rows)).where("doc_id < 10").collect()}
    assert got[0]["spans"] == "email:17:37,remove:0:9" and got[0]["n_terms"] == 1
    assert got[1]["spans"] == got[2]["spans"] == "phone:15:30,generalise:0:7"
    assert all(got[k]["spans"] == "" for k in range(3, 10))


def test_pii_takes_whole_words_of_the_whole_document(spark):
    far = "common words " * 20
    rows = [f"Jonquilla {far}j.q@mail.example.com{' ' * 53}Alexander {far}jonquilla, x.y@mail.example.com"] * 2
    rows += ["ordinary words with common meaning here, ander"] * 60 + ["Alexander words"] * 60
    size, at = len(rows[0]), [rows[0].index(w) for w in ("j.q@", "jonquilla", "x.y@")]
    got = {r["doc_id"]: r for r in pii.op2(frame(spark, rows)).where("doc_id < 4").collect()}
    want = f"email:{at[0]}:{at[0] + 20},email:{at[2]}:{size},remove:0:9,remove:{at[1]}:{at[1] + 9}"
    assert got[0]["spans"] == got[1]["spans"] == want and got[0]["n_terms"] == 2 and got[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert "jonquilla" not in clean[0].lower() and "Alexander" in clean[0] and clean[3] == rows[3]


def test_pii_counts_by_shuffles_give_the_same(spark, monkeypatch):
    rows = ["Jonquilla common j.q@mail.example.com"] + ["Marwick common +1 499 555 6503"] * 2 + ["Marwick common"] + ["ordinary common words"] * 2040
    clashing = frame(spark, rows).withColumns({c: F.lit(c) for c in ("_id", "_digest", "_spans", "key", "h", "term")})
    clashing = clashing.unionByName(clashing.where("doc_id = 1").withColumn("text", F.lit("Unlike 1.2.3.4 text"))).unionByName(clashing.where("doc_id = 0"))
    take = lambda df: sorted(df.where("doc_id < 4").select("doc_id", "text", "_id", "spans").collect())
    small = pii.redact(clashing)
    assert small.columns == clashing.columns
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    got = take(pii.redact(clashing))
    assert got == take(small)
    texts_ = [(r["doc_id"], r["text"]) for r in got]
    first = (0, "<REMOVED> common <EMAIL>")
    assert texts_ == [first, first, (1, "<NAME> common <PHONE>"), (1, "<REMOVED> <IP> <REMOVED>"), (2, "<NAME> common <PHONE>"), (3, "Marwick common")]
    assert all(r["_id"] == "_id" and r["spans"] == "s" for r in got)


def test_license_lines_of_many_documents_and_of_one_file(spark):
    labels = lambda rows: [r["labels"] for r in license_scan.op9(frame(spark, rows)).orderBy("doc_id").collect()]
    hot = ["some text. Licensed under CC BY-NC 4.0. All rights reserved."] * 10 + ["filler words here"] * 20
    assert labels(hot) == ["cc-by-nc,proprietary"] * 10 + [""] * 20
    assert labels(["Licensed under CC BY-SA 4.0."] * 2 + ["x"]) == ["cc-by-sa"] * 2 + [""]
    many = " . ".join(t[1] for t in license_scan.TEMPLATES)
    assert labels([many] + ["filler words here"] * 40)[0] == ",".join(sorted({t[0] for t in license_scan.TEMPLATES}))
