"""PII: information-theoretic sanitisation, with DataFrame functions only.

Direct identifiers (e-mail, IP address, card, phone) are found in every whole text and are the protected entities. Terms are
whole words of at least ``term_size`` letters or digits outside the identifiers; all terms of a document co-occur with all its
entities, and a term that discloses one of them is marked wherever it stands in the documents that hold the entity. From document counts over
the whole corpus, a term t discloses entity e by PMI(t; e) = log2(n(t,e) * N / (n(t) * n(e))) against the entity's
information IC(e) = log2(N / n(e)). PMI / IC is the share of the entity's information in the term; it needs the chance of the
entity where the term stands, n(t,e) / n(t), which few documents give badly. It is smoothed by ``prior`` documents of the
entity's corpus rate: (n(t,e) + prior * n(e) / N) / (n(t) + prior). A term whose smoothed share is at least ``generalise``
discloses the entity, however few documents hold it; such a term is removed if its plain share is at least ``remove``, else
generalised. Texts without an entity stay as they are.

Pairs of terms and entities stand only in documents with an entity, so n(t,e) and n'(t), the documents with an entity that hold the
term, are counted there; as n'(t) is at most n(t), a pair whose share from n'(t) stays below the threshold is left out without loss.
Only the terms of the pairs that remain are counted over the whole corpus. Small sides are broadcast at up to BROADCAST_TERMS rows.

Defined results: null text counts as empty; every input row gives one output row; rows with equal doc_id and text are counted as
separate documents; extra columns are ignored (``redact`` keeps them, whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import limited_broadcast, quoted, row_key, staged

# Kinds and their patterns. Possessive forms keep long runs of characters linear.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LONG_CARD = r"[0-9](?:[\x20-]?[0-9]){15}"
#: Rows (under 100 bytes each) of terms, entities or spans that may be broadcast; more meet by shuffles.
BROADCAST_TERMS = 150_000


def entities(text: Column) -> Column:
    """Base spans of a text, by kind and start."""
    size = lambda s: F.length(S.digits(s["value"]))
    parts = lambda s: F.transform(F.split(s["value"], r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    small = lambda s: F.forall(parts(s), lambda x: (F.length(x) <= 3) & (x.try_cast("int") <= 255))
    return F.concat(
        S.find(text, 0, EMAIL, where=text.contains("@")),
        F.filter(S.find(text, 1, IP), small),
        F.filter(S.find(text, 2, CARD, where=text.rlike(LONG_CARD)), lambda s: size(s).between(16, 19) & S.luhn(s["value"])),
        F.filter(S.find(text, 3, PHONE, where=text.contains("+")), lambda s: size(s).between(8, 15)),
    )


def _outside(text: Column, spans: Column) -> Column:
    """The text with every character of a span made a blank."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    return F.aggregate(S.by_start(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _words(text: Column, pattern: str) -> Column:
    """The different words of a text in lower case; each word is lower-cased by itself, as in _places."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lower))


def _places(text: Column, terms: Column, pattern: str) -> Column:
    """Array of SPAN: the places of those words of a text that are keys of terms, with the terms' kinds."""
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lower(x)).alias("term"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x)).alias("size"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.expr(S.NONE).alias("found"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        kind = F.try_element_at(terms, F.coalesce(x["term"], F.lit("")))
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["term"].alias("value")).cast(S.SPAN)
        return F.struct(end.alias("at"), F.when(kind.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    return F.aggregate(parts, begin, step, lambda acc: acc["found"])


def scan(
    docs: DataFrame, term_size: int = 4, prior: float = 1.0, generalise: float = 0.9, remove: float = 0.999, held_only: bool = False
) -> DataFrame:
    """Rows (doc_id, key, base, spans): base by kind and start; spans also has disclosing terms (kinds 4 and 5); key as of row_key.

    ``held_only`` leaves out the rows of documents without an entity.
    """
    pattern = rf"[\p{{L}}0-9]{{{term_size},}}"
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    found = rows.select("row", "doc_id", "key", "text", entities(text).alias("base"))
    body = F.when(F.size("base") > 0, text)
    kept = staged(found.select("row", "doc_id", "key", "base", body.alias("body")), "entities")

    n = F.lit(float(max(kept.count(), 1)))
    held = kept.where(F.col("body").isNotNull())
    own = held.select("row", F.explode(F.transform("base", lambda s: F.sha2(F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])), 256))).alias("entity")).distinct()
    entity_docs = staged(own.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity_docs")
    clear, whole = _words(_outside(F.col("body"), F.col("base")), pattern), _words(F.col("body"), pattern)
    near = staged(held.select("row", F.explode(clear).alias("term")), "near")
    information = F.log2(n / F.col("n_entity"))
    share = lambda chance: F.when(information > 0, 1 + F.log2(chance) / information).otherwise(0.0)
    smooth = lambda both, all_: (both + prior * F.col("n_entity") / n) / (all_ + prior)
    most = entity_docs.agg(F.coalesce(F.max("n_entity"), F.lit(0)).alias("m")).first()["m"]
    # The threshold, solved for the count of a term that meets the most frequent entity; 1 more for rounding.
    limit = n * F.pow(F.lit(float(most)) / n, F.lit(generalise)) * (1 + prior / n) + 1
    rare = staged(near.groupBy("term").agg(F.count("*").alias("n_held")).where(F.col("n_held") <= limit), "rare")
    bound = share(smooth(F.least("n_held", "n_entity"), F.col("n_held"))) >= generalise
    entity_rows = own.join(limited_broadcast(entity_docs, BROADCAST_TERMS), "entity")
    pairs = near.join(limited_broadcast(rare, BROADCAST_TERMS), "term").join(entity_rows, "row").where(bound)
    pairs = staged(pairs.select("row", "entity", "term", "n_entity", "n_held"), "pairs")
    both = pairs.groupBy("entity", "term", "n_entity", "n_held").agg(F.count("*").alias("n_both"))
    likely = staged(both.where(share(smooth(F.col("n_both"), F.col("n_held"))) >= generalise), "likely")
    terms = staged(likely.select("term").distinct(), "terms")
    # All texts are counted whole; words that only identifiers have, or cut, are set right for the texts with identifiers.
    words = (
        rows.select(F.explode(_words(text, pattern)).alias("term"), F.lit(1).alias("n"))
        .unionByName(held.select(F.explode(F.array_except(whole, clear)).alias("term"), F.lit(-1).alias("n")))
        .unionByName(held.select(F.explode(F.array_except(clear, whole)).alias("term"), F.lit(1).alias("n")))
    )
    count = F.sum("n").alias("n_term")
    if terms.count() <= BROADCAST_TERMS:
        counted = words.join(F.broadcast(terms), "term").groupBy("term").agg(count)
    else:
        counted = words.groupBy("term").agg(count).join(terms, "term")
    disclosing = likely.join(counted, "term").where(share(smooth(F.col("n_both"), F.col("n_term"))) >= generalise).select(
        "entity", "term", share(F.col("n_both") / F.col("n_term")).alias("share")
    )
    marked = pairs.join(disclosing, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= remove, 5).otherwise(4).cast("int")
    lists = marked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", kind.alias("kind")))).alias("terms"))
    places = F.array_sort(_places(_outside(F.col("body"), F.col("base")), F.col("terms"), pattern))
    return (held if held_only else kept).join(lists, "row", "left").select(
        "doc_id", "key", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", places)).alias("spans")
    )


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one. A generalised term becomes the
    class of its wording: a number, a name (capital letter first) or a term."""
    names = F.array(*[F.lit(f"<{n.upper()}>") for n in ("email", "ip", "card", "phone", "term", "removed")])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def name(s):
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(own.rlike("[0-9]"), "<NUMBER>").when(own.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
        return F.when(s["kind"] == 4, general).otherwise(F.element_at(names, s["kind"] + 1))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, name(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    ended = F.aggregate(S.by_start(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, ended).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts.

    A null text stays null and a text without an identifier stays as it is; all other columns stay unchanged, whatever their names;
    rows that share a doc_id are changed by their own texts. Texts aren't shuffled while the rows with spans are few enough to be
    broadcast; beyond that only the texts with identifiers are.
    """
    key, spans = (f"{x}_{uuid.uuid4().hex}" for x in ("key", "spans"))
    found = staged(scan(docs, held_only=True).groupBy("key").agg(F.first("spans").alias("spans")), "found")
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    text = F.col("text").cast("string")
    on = row_key(F.col("doc_id"), text) == F.col(key)
    new = F.when(F.col(spans).isNotNull(), sanitise(text, F.col(spans))).otherwise(text)
    out = [new.alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns]
    if found.count() <= BROADCAST_TERMS:
        return docs.join(F.broadcast(found), on, "left").select(*out)
    held = F.coalesce(F.size(entities(text)) > 0, F.lit(False))
    return docs.where(~held).unionByName(docs.where(held).join(found, on, "left").select(*out))


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id",
        *[S.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(S.label(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.label(F.col("spans"), KINDS).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] > 3)).cast("long").alias("n_terms"),
    )
