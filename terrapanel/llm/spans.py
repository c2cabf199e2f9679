"""Places of pattern matches as column expressions; no Python code runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def find(text: Column, kind: int, pattern: str, group: int = 0, where: Column | None = None) -> Column:
    """Array of SPAN: leftmost non-overlapping matches; value is the given group; start and end in code points.

    The pieces between the matches come from splitting at the same pattern; places are running sums of lengths. Texts for
    which ``where`` (by default: the pattern occurs) doesn't hold give an empty array without that work.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("size"),
        value.alias("value"),
    )
    empty = F.expr(NONE)
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["size"]).alias("end"), x["value"].alias("value"))
        more = F.when(x["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span.cast(SPAN))))
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).alias("at"), more.alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern) if where is None else where, found).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    d = F.transform(F.split(F.reverse(digits(value)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def label(spans: Column, names: tuple[str, ...]) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"], s["kind"].alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
