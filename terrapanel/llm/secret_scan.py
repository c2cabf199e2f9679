"""Secret scans: corpus-wide ownership frequency, with DataFrame functions only.

Every whole text gives candidates: assignments to secret-like names, access keys and hexadecimal runs (base), and long
mixed tokens, signed web tokens and private-key headers (method). Candidate values are hashed and counted by distinct owners and
repositories over the whole corpus. A value seen with more than ``max_owners`` owners or in more than ``max_repositories``
repositories is a widely copied example; any other value whose characters look random is owner-specific and live-looking. Base
spans are always reported; method spans only where the value is owner-specific.

Counting goes through distinct (hash, owner, repository) first, so a value in a third of all documents is reduced
before the shuffle. Values with over a thousandth of all places, at most 1000 of them, meet their places by a broadcast, the
others by a join on the hash, so that no value gathers its places in one task.

Defined results: null text counts as empty; null owner or repository counts as one owner or repository named ''; every
input row gives one output row, repeated rows and null doc_ids included; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import staged

# Kinds and their patterns.
KINDS = ("assign", "access", "hex", "token", "jwt", "pem")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"


def looks_random(value: Column) -> Column:
    """At least 6 different characters, and a third as many as the value is long (at most 12 are asked for)."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return different >= F.greatest(F.lit(6), F.least(F.lit(12), F.ceil(F.length(value) / 3)))


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Rows (row, doc_id, owner, repository, base, more): spans of each whole text, written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    found = rows.select(
        "row", "doc_id", "owner", "repository",
        F.filter(S.find(text, 0, ASSIGN, 1), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        S.find(text, 1, ACCESS, where=text.contains("AKIA")).alias("access"),
        S.find(text, 2, HEX).alias("hex"),
        S.find(text, 3, TOKEN).alias("token"),
        S.find(text, 4, JWT, where=text.contains("eyJ")).alias("jwt"),
        S.find(text, 5, PEM, where=text.contains("-----BEGIN ")).alias("pem"),
    )
    base = F.concat("assign", "access", "hex")
    return staged(
        found.select(
            "row", "doc_id", "owner", "repository", S.by_start(base).alias("base"), F.concat("token", "jwt", "pem").alias("more")
        ),
        "candidates",
    )


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """Rows (doc_id, base, spans, live, n_copied): spans is base plus owner-specific method spans, by start and kind."""
    rows = candidates(docs, owner, repository)
    overlaps = lambda m: F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    own = F.concat("base", F.filter("more", lambda m: ~overlaps(m)))
    each = rows.select("row", "owner", "repository", F.explode(own).alias("s")).withColumn("hash", F.sha2("s.value", 256))
    seen = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"))
    seen = seen.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    owners = seen.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"))
    owners = staged(owners, "owners")
    total = owners.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    hot = F.broadcast(owners.where(F.col("places") * 1000 > total))
    met = each.join(hot, "hash").unionByName(each.join(hot, "hash", "left_anti").join(owners, "hash"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = met.select("row", "s", (~copied & looks_random(F.col("s.value"))).alias("live"), copied.alias("copied"), "repositories")
    lists = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live"), F.col("s"))).alias("live"),
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") > 2), F.col("s"))).alias("added"),
        F.count_if("copied").alias("n_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    empty = F.expr(S.NONE)
    return rows.select("row", "doc_id", "base").join(lists, "row", "left").select(
        "doc_id",
        "base",
        S.by_start(F.concat("base", F.coalesce("added", empty))).alias("spans"),
        S.by_start(F.coalesce("live", empty)).alias("live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )


def op1(docs: DataFrame) -> DataFrame:
    found = scan(docs, F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")))
    return found.select(
        "doc_id",
        S.count(F.col("base"), 0).alias("n_assign"),
        S.count(F.col("base"), 1).alias("n_access"),
        S.count(F.col("base"), 2).alias("n_hex"),
        F.sha2(S.label(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.label(F.col("spans"), KINDS).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        S.label(F.col("live"), KINDS).alias("live_spans"),
        "n_copied",
        "most_repositories",
    )
