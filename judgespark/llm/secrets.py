"""Secrets in texts: sure spans by pattern, weak ones only where complementary parts meet.

All work is DataFrame functions. A pattern's matches are found with their places by cutting the text
at them: the lengths of the pieces and of the matches add up to the offsets. Access identifiers,
secrets and endpoints are then rows with an interval; parts of one document are joined where
their intervals, widened by ``reach`` characters, meet. The join's key is a document and a stretch of
``reach`` characters, so no key grows with the data and the pairs in a stretch are bounded by its
length; each weak span keeps its nearest part.

Null texts count as empty, rows without spans give zero counts and an empty list, repeated rows give
equal results, other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgespark.llm.common import stored, text_of


class Kind(NamedTuple):
    name: str
    role: str  # id, secret or endpoint
    pattern: str
    group: int  # group whose length counts
    least: int
    weak: bool


_EQUALS = r"""["']?\x20*[:=]\x20*["']?"""
# Longest first where one pattern would hide another; the order is that of the reported lists.
KINDS = (
    Kind("assign", "secret", rf"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]){_EQUALS}([A-Za-z0-9+/_.=-]+)", 2, 8, False),
    Kind("access", "id", r"(AKIA[A-Z0-9]+)", 1, 16, False),
    Kind("hex", "secret", r"([0-9a-f]{32,})", 1, 32, False),
    Kind("login", "id", rf"([uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]){_EQUALS}([A-Za-z0-9@+/_.=-]+)", 2, 3, True),
    Kind("short", "secret", rf"([pP][wW][dD]|[pP][aA][sS][sS]|[aA][uU][tT][hH]|[kK][eE][yY]){_EQUALS}([A-Za-z0-9+/_.=-]+)", 2, 4, True),
    Kind("blob", "secret", r"([A-Za-z0-9+/]{40,})", 1, 40, True),
    Kind("endpoint", "endpoint", r"((?:https?|ftp|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D\"'<>]+)", 1, 8, True),
)
REACH = 200
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _matches(kind: Kind, text: Column) -> Column:
    """Per match of one pattern: the kind, its number, the characters before it and in it, and if it counts."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), found.alias("found"), held.alias("held"))
    # The piece after the last match has no match beside it and goes.
    rows = F.transform(
        F.filter(zipped, lambda m: m["found"].isNotNull()),
        lambda m, i: F.struct(
            F.lit(_ORDER[kind.name]).alias("kind"),
            i.alias("no"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["found"]).alias("size"),
            (F.length(m["held"]) >= kind.least).alias("counts"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,no:int,gap:int,size:int,counts:boolean>>")
    return F.when(text.rlike(kind.pattern), rows).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """``(_row, kind, start, end)`` of every match that is long enough, weak ones included."""
    parts = F.concat(*[_matches(k, F.col("text")) for k in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), text_of().alias("text"))
    rows = rows.select("_row", F.explode(parts).alias("m")).select("_row", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far))
    return rows.where("counts").select("_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), kind + 1)


def links(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``(_row, kind, start, end, with_kind, with_start, with_end)``: each weak span that a part of another role
    accompanies, one of the two a secret, and the nearest such part (ties: smallest start, kind, end)."""
    weak = F.element_at(F.array(*[F.lit(k.weak) for k in KINDS]), F.col("kind") + 1)
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    near = found.where(weak).withColumn("role", _role(F.col("kind"))).withColumn(
        "cell", stretch(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach)
    )
    other = found.select(
        F.col("_row").alias("o_row"), F.col("kind").alias("o_kind"), _role(F.col("kind")).alias("o_role"),
        F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        stretch(F.col("start"), F.col("end")).alias("o_cell"),
    )
    meets = (
        (F.col("_row") == F.col("o_row")) & (F.col("cell") == F.col("o_cell"))
        & (F.col("o_role") != F.col("role")) & ((F.col("o_role") == "secret") | (F.col("role") == "secret"))
        & (F.col("o_start") <= F.col("end") + reach) & (F.col("o_end") >= F.col("start") - reach)
    )
    apart = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"), F.lit(0))
    part = F.struct(apart.alias("apart"), "o_start", "o_kind", "o_end")
    nearest = near.join(other, meets).groupBy("_row", "kind", "start", "end").agg(F.min(part).alias("part"))
    return nearest.select(
        "_row", "kind", "start", "end", F.col("part.o_kind").alias("with_kind"),
        F.col("part.o_start").alias("with_start"), F.col("part.o_end").alias("with_end"),
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """All sure spans, and the weak ones of :func:`links` with their part beside them."""
    weak = F.element_at(F.array(*[F.lit(k.weak) for k in KINDS]), F.col("kind") + 1)
    return found.where(~weak).unionByName(links(found, reach), allowMissingColumns=True)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs`` (a stored table): ``doc_id``; ``spans``, an array of ``(start, kind, end)`` by
    start, then kind; and ``links``, each weak span with its nearest part. ``kind`` is the place in ``KINDS``."""
    link = F.struct("start", "kind", "end", "with_start", "with_kind", "with_end")
    # The texts are searched once; the parts then meet from the stored matches.
    spans = linked(stored(candidates(docs)), reach).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("with_kind").isNotNull(), link))).alias("links"),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    unlinked = F.array().cast(
        "array<struct<start:bigint,kind:int,end:bigint,with_start:bigint,with_kind:int,with_end:bigint>>"
    )
    return rows.join(spans, "_row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("links", unlinked).alias("links")
    )


def _span(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1), start, end)


def listing(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: _span(s["kind"], s["start"], s["end"])), ",")


def link_listing(links: Column) -> Column:
    """Links as ``kind:start:end>kind:start:end`` joined by commas, the weak span first."""
    both = lambda s: F.concat(
        _span(s["kind"], s["start"], s["end"]), F.lit(">"), _span(s["with_kind"], s["with_start"], s["with_end"])
    )
    return F.array_join(F.transform(links, both), ",")


def count_of(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == _ORDER[name])).cast("long")


def sure(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < sum(not k.weak for k in KINDS))
