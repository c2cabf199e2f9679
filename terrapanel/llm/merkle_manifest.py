"""Merkle manifest of a dataset with nested-interval labels.

Leaves of each language are ranked by doc_id, and every node carries the interval [lo, hi) of leaf ranks that it covers. Levels are
taken in buckets of ``WIDTH``: the nodes that one node ``WIDTH`` levels up will cover meet in one group of at most 2 ** WIDTH, so
that a tree of any height takes one shuffle a bucket, each 2 ** WIDTH times smaller than the one before. The difference between
a parent's interval and a node's own names the node's sibling. Ancestors are attached by a containment join within the bucket
(equal language and bucket, the ancestor's interval holds the leaf's rank), bucket by bucket from the top, and the subroots of
the languages are the leaves of one more tree of the same kind.

Ranks come from a range exchange of digests by (lang, doc_id, leaf) and counts of its parts, so a language with a third of all
rows is spread over many tasks; texts are hashed where they are read and never shuffled.

Defined results: a null field is `-` in its leaf; a null lang is a language of its own, before all others; null doc_ids come first
in their language and are never tampered with; rows that share a doc_id are ordered by leaf digest (equal rows are equal leaves,
each with its own place); a node alone in its run is hashed alone; empty texts are `0:`; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import limited_broadcast, staged

#: Levels of a bucket; 2 ** WIDTH nodes meet in one group.
WIDTH = 6
#: Languages whose subroots are broadcast; with more of them Spark joins by shuffles.
BROADCAST_ROWS = 150_000
_LINKS = "array<struct<level: int, lo: bigint, hi: bigint, digest: string, sibling: string, after: boolean>>"


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, leaf, forged): digest of every row, and of the row as tampered with. ``key`` orders as lang, null first."""
    head, tail = [field(F.col(c)) for c in ("doc_id", "source", "lang")], field(F.col("text"))
    digest = lambda n: F.sha2(F.concat(*head, field(n), tail), 256)
    n = F.col("n_chars").cast("decimal(20,0)")
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaf = digest(n)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang"))).alias("key"),
        leaf.alias("leaf"),
        F.when(struck & n.isNotNull(), digest(n + 1)).otherwise(leaf).alias("forged"),
    )


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with ``lo``, ``hi`` = lo + 1 and ``n``: rank within the key in the given order, and the key's number of rows.

    One range exchange; parts of its partitions are counted and their sums give where each begins.
    """
    by = [F.col(key), *order, F.col("_tie")]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = staged(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy(key)
    counted = placed.groupBy("_part", key).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    starts = counted.select(
        "_part", key, "_first", F.sum("_rows").over(own).alias("n"),
        (F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_start"),
    )
    lo = F.col("_at") - F.col("_first") + F.col("_start")
    joined = placed.join(limited_broadcast(starts, BROADCAST_ROWS), ["_part", key]).withColumn("lo", lo)
    return joined.withColumn("hi", F.col("lo") + 1).drop("_at", "_part", "_first", "_start")


def _link(level: int):
    """Link of a node (of ``kids``, within the parent's interval lo, hi): the rest of the parent's interval is its sibling's."""

    def link(kid: Column) -> Column:
        rest = F.filter("kids", lambda other: (other["lo"] >= kid["hi"]) | (other["hi"] <= kid["lo"]))
        sibling = F.coalesce(F.get(rest["digest"], F.lit(0)), F.lit(""))
        after = F.col("lo") == kid["lo"]
        return F.struct(F.lit(level).alias("level"), kid["lo"].alias("lo"), kid["hi"].alias("hi"), kid["digest"].alias("digest"), sibling.alias("sibling"), after.alias("after"))

    return link


def climb(base: DataFrame, level: int, top: int) -> DataFrame:
    """One bucket of levels: rows (key, n, bucket, lo, hi, digest, links) of the nodes at level ``top``, at most ``WIDTH`` above ``base``.

    base: (key, n, lo, hi, digest) of all nodes of one level; a node that covers all n leaves is the root and stays as it is.
    ``links`` holds every node below: its level, interval and digest, and the sibling that the interval difference with its
    parent names ('' where the difference is empty).
    """
    bucket = F.shiftright("lo", level + WIDTH)
    rows = base.select("key", "n", bucket.alias("bucket"), "lo", "hi", "digest", F.array().cast(_LINKS).alias("links")).repartition("key", "bucket")
    for at in range(level, top):
        run = rows.groupBy("key", "bucket", "n", F.shiftright("lo", at + 1).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"), F.flatten(F.collect_list("links")).alias("below")
        )
        run = run.withColumns({"lo": F.array_min("kids.lo"), "hi": F.array_max("kids.hi")})
        root = (F.element_at("kids", 1)["hi"] - F.element_at("kids", 1)["lo"]) == F.col("n")
        rows = run.select(
            "key", "n", "bucket", "lo", "hi",
            F.when(root, F.element_at("kids", 1)["digest"]).otherwise(F.sha2(F.concat_ws("", "kids.digest"), 256)).alias("digest"),
            F.when(root, F.col("below")).otherwise(F.concat("below", F.transform("kids", _link(at)))).cast(_LINKS).alias("links"),
        )
    return rows


def attach(base: DataFrame, climbed: DataFrame, level: int, own: list[str]) -> DataFrame:
    """base's columns ``own`` and key, bucket, lo, with ``path``: the links of its ancestors and itself in this bucket of levels, from below."""
    nodes = climbed.select(F.col("key").alias("_key"), F.col("bucket").alias("_bucket"), F.explode("links").alias("node"))
    low = base.withColumn("bucket", F.shiftright("lo", level + WIDTH))
    holds = (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")) & (F.col("node.lo") <= F.col("lo")) & (F.col("hi") <= F.col("node.hi"))
    step = F.when(F.col("node").isNotNull(), F.struct("node.level", "node.after", "node.sibling"))
    return low.join(nodes, holds, "left").groupBy("key", "bucket", "lo", *own).agg(F.array_sort(F.collect_list(step)).alias("path"))


def tree(base: DataFrame, tops: DataFrame | None = None, own: tuple[str, ...] = ()):
    """Build the trees of all keys over base (key, n, lo, hi, digest, *own).

    Returns (roots, paths): roots has key and digest; paths(above) has base's rows with key, lo, ``own`` and their whole path, where
    above (key, subroot, path) continues the path of every key's root, if given.
    """
    height = max(1, ((base.agg(F.max("n")).first()[0] or 1) - 1).bit_length())
    buckets = -(-height // WIDTH)
    levels, rows = [], base
    for k in range(buckets):
        climbed = staged(climb(rows, k * WIDTH, min(height, (k + 1) * WIDTH)), f"nodes{k}")
        levels.append((rows, climbed))
        rows = climbed.select("key", "n", "lo", "hi", "digest")
    roots = rows.select("key", "digest")

    def paths(above: DataFrame | None) -> DataFrame:
        whole = None
        for k in reversed(range(buckets)):
            low, climbed = levels[k]
            names = list(own) if k == 0 else []
            found = attach(low, climbed, k * WIDTH, names)
            if whole is not None:
                found = found.join(whole, ["key", "bucket"])
            elif above is not None:
                found = found.join(above, "key")
            else:
                found = found.withColumns({"subroot": F.lit(None).cast("string"), "above": F.array().cast("array<struct<level: int, after: boolean, sibling: string>>")})
            found = found.select("key", "lo", *names, "subroot", F.concat("path", "above").alias("path"))
            if k:
                whole = staged(found, f"paths{k}").select("key", F.shiftright("lo", k * WIDTH).alias("bucket"), "subroot", F.col("path").alias("above"))
        return found

    return roots, paths


def folded(start: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.when(step["after"], F.concat(digest, step["sibling"])).otherwise(F.concat(step["sibling"], digest)), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lo, path): every row's place in its language, its
    siblings up to the root, and the root that its tampered leaf gives."""
    base = staged(ranked(leaves(docs), "key", [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).withColumnRenamed("leaf", "digest"), "leaves")
    roots, paths = tree(base, own=("doc_id", "digest", "forged"))
    subroots = staged(ranked(roots.select(F.lit("").alias("key"), F.col("key").alias("lang"), "digest"), "key", [F.col("lang")]), "subroots")
    top, top_paths = tree(subroots, own=("lang", "digest"))
    row = top.first()
    above = staged(top_paths(None).select(F.col("lang").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("above")), "tops")
    root = F.lit(row["digest"] if row else None).cast("string")
    return (
        paths(limited_broadcast(above, BROADCAST_ROWS))
        .select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(F.concat_ws("", "path.sibling"), 256).alias("proof_sha256"), folded(F.col("forged"), F.col("path")).alias("folded_root"), "lo", "path")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op12(docs: DataFrame) -> DataFrame:
    return manifest(docs).drop("lo", "path")


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256({} || {} || {} || {{}} || {})".format(*[_FIELD.format(c) for c in ("doc_id", "source", "lang", "text")])
#: crc32 of the decimal doc_id, bit by bit: each byte joins the register at the first of its eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
_TREE = """{0}(key, level, pos, digest) AS (SELECT key, 0, pos, digest FROM {1} UNION ALL
    SELECT key, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {0}) WHERE n > 1 GROUP BY key, level, pos // 2)"""
_STEPS = """SELECT r.rid, n.level + {2} AS level, (n.pos % 2)::VARCHAR || coalesce(s.digest, '') AS step FROM {0} r JOIN {1} n ON n.key = r.{3} AND n.pos = r.{4} >> n.level
    JOIN (SELECT key, max(level) AS height FROM {1} GROUP BY 1) h ON h.key = n.key AND n.level < h.height LEFT JOIN {1} s ON s.key = n.key AND s.level = n.level AND s.pos = xor(n.pos, 1)"""

#: DuckDB statement for op12: both trees by recursion over levels, siblings by position.
SQL = f"""WITH RECURSIVE raw AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key, {_LEAF.format(_FIELD.format("n_chars"))} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(_FIELD.format("(n_chars + 1)"))} END AS struck FROM documents),
leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid FROM raw),
{_TREE.format("nodes", "leaves")},
subs AS (SELECT key AS lang, arg_max(digest, level) AS digest FROM nodes GROUP BY 1),
subroots AS (SELECT '' AS key, lang, digest, row_number() OVER (ORDER BY lang) - 1 AS pos FROM subs),
{_TREE.format("tops", "subroots")},
placed AS (SELECT l.*, t.digest AS subroot, t.pos AS top_pos, '' AS top_key FROM leaves l JOIN subroots t ON t.lang = l.key),
steps AS ({_STEPS.format("placed", "nodes", 0, "key", "pos")} UNION ALL {_STEPS.format("placed", "tops", 1000, "top_key", "top_pos")}),
paths AS (SELECT p.*, coalesce(s.steps, []) AS steps FROM placed p LEFT JOIN (SELECT rid, list(step ORDER BY level) AS steps FROM steps GROUP BY 1) s USING (rid)),
folded AS (SELECT *, list_reduce(list_concat([coalesce(struck, leaf)], steps), lambda a, e: sha256(CASE WHEN e[1] = '0' THEN a || e[2:] ELSE e[2:] || a END)) AS folded_root,
    (SELECT arg_max(digest, level) FROM tops) AS root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda e: e[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
