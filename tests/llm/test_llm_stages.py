"""Every pipeline stage with hard rows and column names, and near copies with planted edits."""

import random

import pytest
from pyspark.sql import functions as F

from terrapanel.llm import decontamination, pii, quality, simhash_golay

NAMES = ["a.b", "x`y", "key", "row", "spans", "c0", "`", "select", "a b"]
ROWS = [
    (1, "mail me at one@host.org or +49 30 1234567 now", "en"), (1, "another row of the same id", None), (None, None, "en"), (None, "", "de"), (4, "", "en"), (5, "word " * 3000, "en"),
    (6, "mail me at one@host.org or +49 30 1234567 now", "en"), (6, "mail me at one@host.org or +49 30 1234567 now", "en"), (7, "the leaked benchmark passage stands here in ten words or so", "en"),
]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("doc_id", F.lit(3).alias("a.b"), "text", F.lit(None).cast("string").alias("x`y"), "lang", *[F.lit(k).alias(n) for k, n in enumerate(NAMES[2:])])


def stages(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "leaked benchmark passage stands here in ten words or so")], "item_id long, text string")
    return {
        "quality": lambda d: quality.keep_good(d, labels, threshold=-1.0),
        "copies": lambda d: simhash_golay.drop_near_duplicates(d, measure="cosine"),
        "leaks": lambda d: decontamination.drop_contaminated(d, bench),
        "pii": pii.redact,
    }


@pytest.mark.parametrize("name", ["quality", "copies", "leaks", "pii"])
def test_stage_keeps_columns_of_any_name(spark, name):
    docs = documents(spark)
    done = stages(spark)[name](docs)
    assert done.columns == docs.columns
    kept = [tuple(r) for r in done.collect()]
    others = lambda rows: [tuple(v for c, v in zip(docs.columns, r) if c not in ("text", "doc_id", "lang")) for r in rows]
    assert set(others(kept)) == set(others(map(tuple, docs.collect())))
    ids = [r[0] for r in kept]
    if name in ("quality", "pii"):
        assert len(kept) == len(ROWS)
    if name == "leaks":
        assert len(kept) == len(ROWS) - 1 and 7 not in ids
    if name == "copies":  # null and empty texts are copies of each other, as are rows 1 and 6
        assert sorted(str(x) for x in ids) == ["1", "1", "5", "7", "None"]
    if name == "pii":
        texts = [r[docs.columns.index("text")] for r in kept]
        assert sum("one@host.org" in (t or "") for t in texts) == 0 and texts.count(None) == 1 and texts.count("") == 2
    assert stages(spark)[name](docs.limit(0)).count() == 0


def edited(words, share, rng):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_copies_with_planted_edits(spark):
    rng = random.Random(2)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    originals = [line(300) for _ in range(40)]
    rows, copies = [(k, " ".join(w)) for k, w in enumerate(originals)], {}
    for share in (0.01, 0.02, 0.03):
        for w in originals:
            copies[len(rows)] = share
            rows.append((len(rows), " ".join(edited(w, share, rng))))
    # A text that holds another one and as much again isn't its copy, nor are texts with a shared passage of a third.
    apart = list(range(len(rows), len(rows) + 30))
    rows += [(k, " ".join(originals[k % 40] + line(300))) if k % 2 else (k, " ".join(originals[k % 40][:100] + line(200))) for k in apart]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    left = {r[0] for r in simhash_golay.drop_near_duplicates(df, measure="cosine").select("doc_id").collect()}
    assert set(range(40)) <= left and set(apart) <= left
    caught = {share: [k not in left for k, s in copies.items() if s == share] for share in (0.01, 0.02, 0.03)}
    assert all(sum(x) / len(x) >= 0.9 for x in caught.values()), caught


def test_cosine_equals_plain_counts():
    import numpy as np

    rng = random.Random(5)
    sets = [np.unique([rng.randrange(40) for _ in range(rng.randrange(0, 40))]).astype("<u8") for _ in range(60)]
    near = simhash_golay.similar(0.8, "cosine")([s.tobytes() for s in sets])
    for i in range(60):
        j = np.arange(60)
        want = [len(np.intersect1d(sets[i], sets[k])) >= 0.8 * np.sqrt(max(len(sets[i]) * len(sets[k]), 1)) - 1e-9 for k in j]
        assert near(np.full(60, i), j).tolist() == want
