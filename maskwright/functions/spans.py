"""Typed spans of a text as Catalyst expressions: finding, overlap, resolution, substitution.

A span is ``struct<start:int, end:int, text:string, entity_type:string, detector_name:string, priority:int>`` with code
point offsets, end exclusive. Every function here takes and returns Columns, so whole pipelines stay in one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,entity_type:string,detector_name:string,priority:int>"
SPANS = f"array<{SPAN}>"
ENTITY_TYPES = ("PERSON", "EMAIL", "PHONE", "HANDLE", "TERM")
PRIORITY = {"EMAIL": 100, "PHONE": 90, "HANDLE": 80, "TERM": 70, "PERSON": 10}
#: Tokens that an earlier pass left in a text.
TOKEN_PATTERN = r"\[\[([A-Z]+)_([a-z0-9]+(?:-\p{Nd}+)?)\]\]"
#: Letters, numbers and underscore: what a word character is in the patterns of this package.
WORD = r"\p{L}\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* over *value*, which is computed once: inside lambdas nothing shares common expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def regex_spans(text: Column, pattern: str, entity_type: str, detector: str, priority: int | None = None, needle: str | None = None) -> Column:
    """All matches of *pattern*, left to right. A *needle* that every match contains spares other texts the search.

    Offsets are sums of the lengths of matches and of the gaps between them.
    """
    rank = PRIORITY[entity_type] if priority is None else priority
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), F.lit(entity_type).alias("entity_type"), F.lit(detector).alias("detector_name"), F.lit(rank).alias("priority"))
        return F.struct(end.alias("pos"), F.array_append(acc["out"], span).cast(SPANS).alias("out"))

    spans = F.aggregate(both, F.struct(F.lit(0).alias("pos"), no_spans().alias("out")), step, lambda acc: acc["out"])
    some = F.contains(text, F.lit(needle)) if needle else text.rlike(pattern)
    return F.when(some, spans).otherwise(no_spans())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def own_tokens(text: Column) -> Column:
    return regex_spans(text, TOKEN_PATTERN, "PERSON", "__own_token__", 9999, needle="[[")


def outside(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of *taken*."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda o: overlaps(s, o)))


def resolve(spans: Column) -> Column:
    """Greedy choice: longer first, then higher priority, then earlier, then detector name; what overlaps a span already
    chosen goes. Sorted by start. A span that only overlaps rejected ones stays, so this is a fold, not an anti-join."""
    return let(spans, _resolved)


def _resolved(spans: Column) -> Column:
    fields = ("start", "end", "text", "entity_type", "detector_name", "priority")
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            (s["start"] - s["end"]).alias("k1"), (-s["priority"]).alias("k2"), s["start"].alias("start"), s["detector_name"].alias("detector_name"),
            s["end"].alias("end"), s["text"].alias("text"), s["entity_type"].alias("entity_type"), s["priority"].alias("priority"),
        ),
    )
    plain = F.transform(F.sort_array(keyed), lambda s: F.struct(*(s[f].alias(f) for f in fields)))
    chosen = F.aggregate(plain, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda a: overlaps(a, s)), acc).otherwise(F.array_append(acc, s)).cast(SPANS))
    return F.when(F.size(spans) < 2, spans).otherwise(F.sort_array(chosen))


def substitute(text: Column, spans: Column, replacements: Column) -> Column:
    """*text* with each of the resolved *spans* replaced by the string at its place in *replacements*."""
    parts = F.zip_with(
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0).alias("from"))),
        replacements,
        lambda s, r: F.concat(F.substring(text, s["from"] + 1, s["start"] - s["from"]), r),
    )
    rest = F.get(spans, F.size(spans) - 1)["end"]
    done = F.concat(F.array_join(parts, ""), F.substring(text, rest + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def format_token(entity_type: Column, token: Column) -> Column:
    return F.concat(F.lit("[["), entity_type, F.lit("_"), token, F.lit("]]"))
