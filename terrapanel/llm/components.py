"""Links inside sorted buckets, and connected components, for the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, staged_at

#: Rows of a bucket that are compared as one block; a larger bucket is dealt out in parts of about this size.
BLOCK = 512
#: Rows of a large bucket that are compared with all its rows first.
LEADERS = 64
#: Buckets that a sketch may name as hot.
HOT = 1000
_SMALL = 16
LINKS = "a long, b long, bucket long"
_FIELDS = [("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())]


def _forest(near, rows: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (pairs of row numbers) of the rows of one block that ``near`` links: each row that is reached is
    compared with those not reached yet."""
    out = []
    while len(rows):
        reached, rows = [rows[0]], rows[1:]
        while reached and len(rows):
            r = reached.pop()
            linked = near(np.full(len(rows), r), rows)
            out += [(x, r) for x in rows[linked].tolist()]
            reached += rows[linked].tolist()
            rows = rows[~linked]
    return out


def _block_links(bucket: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs inside buckets of rows sorted by bucket; large buckets give a spanning forest only."""
    n = len(bucket)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]])
    sizes = np.diff(starts)
    left, right = [], []
    active = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _SMALL), sizes))
    for step in range(1, _SMALL):
        active = active[active + step < n]
        active = active[bucket[active] == bucket[active + step]]
        if not len(active):
            break
        linked = active[near(active, active + step)]
        left.append(linked)
        right.append(linked + step)
    for g in np.flatnonzero(sizes > _SMALL):
        pairs = _forest(near, np.arange(starts[g], starts[g + 1]))
        left.append(np.array([x for x, _ in pairs], int))
        right.append(np.array([y for _, y in pairs], int))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows of LINKS without a bucket: links between different nodes, each once."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    low, high = low[low != high], high[low != high]
    if len(low):
        low, high = np.unique(np.stack([low, high]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.nulls(len(low), pa.int64())], schema=pa.schema(_FIELDS))


def _open(node: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Rows of LINKS with a bucket: rows that are still to be compared in it."""
    return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(bucket)], schema=pa.schema(_FIELDS))


def _linker(predicate):
    """mapInArrow function over rows (bucket, node, data) sorted by bucket: links of buckets of at most BLOCK rows, and the rows
    of larger ones, which are passed on without being held."""

    def links(bucket, node, data):
        a, b = _block_links(bucket, predicate(data))
        return _links(node[a], node[b])

    def whole(bucket, node, data):
        """Of whole buckets."""
        starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(bucket)))
        large = np.repeat(sizes > BLOCK, sizes)
        yield links(bucket[~large], node[~large], data[~large])
        if large.any():
            yield _open(node[large], bucket[large])

    def run(batches):
        held, large = None, None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            if not len(now[0]):
                continue
            if large is not None:
                n = int(np.searchsorted(now[0], large, "right"))
                yield _open(now[1][:n], now[0][:n])
                now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                large = None
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from whole(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            if len(held[0]) > BLOCK:
                yield _open(held[1], held[0])
                held, large = None, held[0][0]
        if held is not None:
            yield from whole(*held)

    return run


def _against(predicate):
    """mapInArrow function over rows (part, bucket, node, data, lead) of parts that lie together, leading rows first: a
    forest of the leading rows' links and one link of each other row with each group of linked leading rows that it meets, and the
    other rows that have none with the largest group."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    def flush(rows):
        node, bucket = np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        n = sum(r[4] for r in rows)
        binary = isinstance(rows[0][3], bytes)
        near = predicate(np.array([r[3] for r in rows], object if binary else np.int64))
        every, group = np.arange(len(rows)), np.arange(n)
        linked = [every[near(np.full(len(rows), r), every)] for r in range(n)]
        out = []
        for r, found in enumerate(linked):
            for x in found[found < n].tolist():
                if group[x] != group[r]:
                    out.append((x, r))
                    group[group == group[x]] = group[r]
        met = {g: np.zeros(len(rows), bool) for g in group.tolist()}
        for r, found in enumerate(linked):
            seen = met[group[r]]
            out += [(x, r) for x in found[(found >= n) & ~seen[found]].tolist()]
            seen[found] = True
        yield _links(*(node[np.array(x, int)] for x in zip(*out, strict=True))) if out else _links(node[:0], node[:0])
        alone = np.ones(len(rows), bool)
        alone[:n] = False
        if n:
            alone &= ~met[np.bincount(group).argmax()]
        yield _open(node[alone], bucket[alone])

    return run


def _large_links(rows: DataFrame, predicate) -> DataFrame:
    """Links of the rows (bucket, node, data) of large buckets, enough of them to keep all components.

    About LEADERS rows a bucket, those of the smallest hashes, are compared with all its rows, which are dealt out in parts of about
    BLOCK rows. A row that leads in one bucket mostly leads in others too, so that buckets with the same rows give the same links. The
    leaders that link directly form groups, the same in every part; a row gives one link with each group that it meets. Rows linked
    to the largest group are connected with each other already, and each of the others is compared with all rows of its bucket,
    part by part.
    """
    rows = staged(rows, "large")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    whole = rows.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / BLOCK))
    dealt = F.pmod(F.xxhash64("node"), F.col("parts"))
    place = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 53)).cast("double")
    names = ("part", "bucket", "node", "data", "lead")

    def compared(leading: DataFrame, others: DataFrame) -> DataFrame:
        both = leading.select(*names).unionByName(others.select(*names))
        return both.repartition("part").sortWithinPartitions("part", F.col("lead").desc(), place, "node").mapInArrow(_against(predicate), LINKS)

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    leaders = whole.where(place * F.col("n") < LEADERS * 2.0**53).withColumn("at", every)
    keyed = lambda df, lead: df.withColumn("part", F.xxhash64("bucket", "at")).withColumn("lead", F.lit(lead))
    first = staged(compared(keyed(leaders, True), keyed(whole.withColumn("at", dealt), False)), "led")
    links, alone = first.where("bucket is null"), first.where("bucket is not null").select("bucket", F.col("a").alias("node"))
    if alone.isEmpty():
        return links
    counts = alone.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    left = whole.join(alone, ["bucket", "node"], "left_semi").join(counts, "bucket")
    again = lambda df, lead: df.withColumn("part", F.xxhash64("bucket", "at", "block")).withColumn("lead", F.lit(lead))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks"))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    leading = left.withColumn("block", own).withColumn("at", every)
    others = whole.join(counts, "bucket").withColumn("at", dealt).withColumn("block", all_blocks)
    return links.unionByName(compared(again(leading, True), again(others, False)).where("bucket is null"))


def hot_buckets(keys: DataFrame) -> list[int]:
    """Buckets that hold more than about a thousandth of all rows, from one sketch of bounded size; at most HOT of them."""
    found = keys.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(bucket, {HOT}, {8 * HOT})").alias("top")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > max(BLOCK, found["n"] / HOT)]


def bucket_links(keys: DataFrame, predicate) -> DataFrame:
    """Rows (a, b), a > b: nodes that share a bucket and that ``predicate`` links, enough of them to keep all components.

    keys has (bucket long, node long, data long or binary). predicate(data) gives near(i, j) over row numbers. Buckets are read in
    sorted order, a batch at a time. Hot buckets, known from a sketch, and those that turn out to hold more than BLOCK rows are
    dealt out in parts instead (_large_links), so that no task holds more than a few blocks and no link between components is lost.
    """
    keys = keys.select("bucket", "node", "data")
    hot = hot_buckets(keys)
    cold = keys.where(~F.col("bucket").isin(hot)) if hot else keys
    found = staged(cold.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_linker(predicate), LINKS), "links")
    links = found.where("bucket is null").select("a", "b")
    large = found.where("bucket is not null").select("bucket", F.col("a").alias("node"))
    parts = [keys.where(F.col("bucket").isin(hot))] if hot else []
    if not large.isEmpty():
        parts.append(cold.join(large.distinct(), ["bucket", "node"], "left_semi"))
    for part in parts:
        links = links.unionByName(_large_links(part.distinct(), predicate).select("a", "b"))
    return links.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b) but the roots: root is the smallest node that can be reached.

    Alternating large-star and small-star steps; every round is written to the shared folder, and the one before it removed.
    """
    spark = links.sparkSession
    edges, path = staged_at(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        star = star.unionByName(low.where("low < a").select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        small = star.groupBy("a").agg(F.min("b").alias("low"))
        joined = star.join(small, "a")
        edges = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges, after = staged_at(edges.unionByName(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "edges")
        discard(spark, path)
        path = after
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = state
    raise RuntimeError(f"components aren't settled after {rounds} rounds")
