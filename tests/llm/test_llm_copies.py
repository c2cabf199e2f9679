"""Repeated spans, fingerprints and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrapanel.llm import components, simhash_golay, substring_dedup

VOCABULARY = [f"w{k}" for k in range(400)]


def corpus(seed=4):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    passage, base, out = line(50), line(120), [None, "", "a", "a " * 100, "a b " * 40, line(19), line(20)]
    for _ in range(15):
        out.append(line(rng.randrange(5, 60)) + " " + passage + "\n" + line(rng.randrange(5, 60)))
    for _ in range(20):
        words = base.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    return out + [base] * 5 + [out[-1], line(300), "a b " * 40]


def frame(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return df.withColumns({"k": F.lit("clash"), "copy": F.lit(1), "fp": F.lit(2), "digest": F.lit("d")}).repartition(5)


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    for window, anchor in ((20, 6), (8, 3)):
        first, want = {}, {}
        words = [(t or "").encode().split() for t in rows]
        for d, w in enumerate(words):
            for i in range(len(w) - window + 1):
                first.setdefault(tuple(w[i : i + window]), (d, i))
        for d, w in enumerate(words):
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] != (d, i):
                    gone[i : i + window] = [True] * window
            kept = b" ".join(x for x, g in zip(w, gone) if not g)
            want[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        got = substring_dedup.dedup(frame(spark, rows), window, anchor).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_substring_dedup_edges(spark):
    df = spark.createDataFrame([(None, "b " * 30), (1, "b " * 30), (1, "b " * 30), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_removed"]) for r in substring_dedup.op5(df).collect()), key=str)
    assert len(got) == 4 and got[0] == (False, None, 29)
    assert substring_dedup.op5(df.limit(0)).count() == 0


def test_substring_dedup_keeps_rows_of_one_doc_id_apart(spark):
    a, z = (" ".join(f"{x}{k}" for k in range(40)) for x in "az")
    tail = a.split(" ", 10)[10]
    rows = [(1, a), (2, a), (2, z), (None, "x " + z), (None, "y " + z), (5, "q " + tail + " r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.op5(docs).collect()), key=str)
    assert got == sorted([(1, 40, 0), (2, 40, 40), (2, 40, 40), (None, 41, 0), (None, 41, 0), (5, 32, 30)], key=str)
    apart = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.op5(apart).collect()) == [(1, 0), (2, 0), (2, 40)]


def test_substring_dedup_compacts_repeats_into_long_paths(spark):
    line = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(k, f"a{k} " + line + f" b{k}") for k in range(4)] + [(9, "c " + line[: line.index(" w150")])], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that several batches hold the words
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    keyed, _ = substring_dedup.sources_of(docs)
    late, places = substring_dedup.units(keyed, 20, 6)
    long = substring_dedup.compacted(places)
    n = long.count()
    assert 0 < n < places.count() / 3 and substring_dedup.confirmed(keyed, long, 20).count() == n
    wrong = long.withColumn("sat", F.col("sat") + 1)
    assert substring_dedup.confirmed(keyed, wrong, 20).count() == 0
    want = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.op5(docs).collect())
    assert want == [(0, 0), (1, 300), (2, 300), (3, 300), (9, 150)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_golay_code():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000).astype(np.int32)
    keys = simhash_golay.fuzzy_keys(words)
    counts = (keys >= 0).sum(1)
    assert set(counts.tolist()) <= {1, 6}
    for bit in range(23):
        near = simhash_golay.fuzzy_keys(words ^ (1 << bit))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys[:200], near[:200]))


def planted_prints():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    out = list(base)
    for x in base[:150]:
        for flips in (1, 2, 3, 4):
            out.append(x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, flips, replace=False).astype(np.uint64)))
    cluster = [base[0] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(a, 64)]
    return np.unique(np.array(out + cluster + [np.uint64(0)], np.uint64))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3):
            parent[find(i)] = find(int(i + 1 + j))
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(int(prints[i].astype(np.int64)))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_fingerprint_links_equal_brute_force(spark, monkeypatch):
    prints = planted_prints()
    want = brute_components(prints)
    df = spark.createDataFrame([(int(x.astype(np.int64)),) for x in prints], "fp long")
    for block, leaders in ((2048, 64), (64, 64), (64, 3)):
        monkeypatch.setattr(components, "BLOCK", block)
        monkeypatch.setattr(components, "LEADERS", leaders)
        roots = components.components(simhash_golay.fingerprint_links(df)).collect()
        groups = {}
        for r in roots:
            groups.setdefault(r["root"], {r["root"]}).add(r["node"])
        assert {frozenset(g) for g in groups.values()} == want


def test_op10_edges(spark):
    rows = [None, "", "One two", "one TWO", "a b c d e f g h", "a b c d e f g h"]
    got = {r["doc_id"]: r for r in simhash_golay.op10(frame(spark, rows)).collect()}
    assert got[0]["fingerprint"] == "0" * 16 and got[1]["component_id"] == 0
    assert got[2]["fingerprint"] == f"{xxhash.xxh64_intdigest(b'one two', 42):016x}" and got[3]["component_id"] == 2 and got[5]["component_id"] == 4
    assert simhash_golay.op10(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = random.Random(9)
    line = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows = []
    for _ in range(20):
        base = line(200)
        near = list(base)
        near[100] = "changed"
        rows += [" ".join(base), " ".join(near), " ".join(base).upper(), " ".join(line(200))]
    kept = {r["doc_id"] for r in simhash_golay.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {k for k in range(80) if k % 4 in (0, 3)}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        assert after.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = after
    again = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256")
    assert sorted(again.collect()) == sorted(docs.select("doc_id", "ids_sha256").collect()) and docs.count() > 50


def test_near_duplicate_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [None, "", " ", "one two", "One  Two", "one two three four five"]
    for size in (12, 40, 150):
        base = [rng.choice(VOCABULARY) for _ in range(size)]
        for edits in [0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6] * 3:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = rng.choice(VOCABULARY)
            rows.append(" ".join(words))
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if x == high else x for x in parent]
    want = {k: r for k, r in enumerate(parent) if k != r}
    for block, leaders in ((2048, 64), (16, 2)):
        monkeypatch.setattr(components, "BLOCK", block)
        monkeypatch.setattr(components, "LEADERS", leaders)
        groups = simhash_golay.near_duplicate_groups(frame(spark, rows)).collect()
        assert {r["key"]["k"]: r["root"]["k"] for r in groups if r["key"] != r["root"]} == want


def test_chains_in_a_large_bucket_stay_whole(spark, monkeypatch):
    """Numbers link where they differ by at most 3: one long chain, in which leaders reach few rows."""
    monkeypatch.setattr(components, "BLOCK", 32)
    monkeypatch.setattr(components, "LEADERS", 4)
    near = lambda data: lambda i, j: np.abs(data[i] - data[j]) <= 3
    keys = spark.createDataFrame([(7, k, 3 * k + 1000 * (k // 100)) for k in range(300)] + [(8, 1000, 1), (8, 1001, 2)], "bucket long, node long, data long")
    roots = components.components(components.bucket_links(keys, near)).collect()
    assert {r["node"]: r["root"] for r in roots} == {k: k // 100 * 100 for k in range(300) if k % 100} | {1001: 1000}


def test_rows_that_share_a_doc_id_are_judged_apart(spark):
    a, b, z = (" ".join(f"{x}{k}" for k in range(40)) for x in "abz")
    rows = [(1, a), (2, a), (2, z), (None, b), (None, b), (None, z + " more"), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumns({c: F.lit(c) for c in ("_key", "key", "k", "root", "node", "digest", "n", "h", "_id", "_digest", "_spans")})
    for docs in (df, clash):
        kept = simhash_golay.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted([(1, a), (None, b), (None, z + " more"), (3, None)], key=str)
    assert {r["_key"] for r in simhash_golay.drop_near_duplicates(clash).collect()} == {"_key"}
    assert simhash_golay.drop_near_duplicates(clash.limit(0)).columns == clash.columns


def test_large_bucket_of_copies_gives_few_links(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 32)
    monkeypatch.setattr(components, "LEADERS", 8)
    rows = [(bucket, node, 0 if node % 3 else 1 << 20) for bucket in (1, 2, 3) for node in range(600)]
    keys = spark.createDataFrame(rows, "bucket long, node long, data long")
    links = components.bucket_links(keys, lambda data: lambda i, j: data[i] == data[j])
    assert links.count() < 3 * 600
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert all(roots.get(node, node) == (1 if node % 3 else 0) for node in range(600))
