"""Windows, rankings, limits and deduplication. Order is data: every function takes it as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POSITION_ENDS, SECTIONS


def relative_position(keys: list[str], order: list[Column]) -> Column:
    """Index over last index, 0 to 1; a single row is 0."""
    w = Window.partitionBy(*keys)
    return (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)


def position_section(position: Column, ends: tuple[float, ...] = POSITION_ENDS["packets"]) -> Column:
    out = F.when(position <= ends[0], SECTIONS[0])
    for label, end in zip(SECTIONS[1:], ends[1:], strict=False):
        out = out.when(position <= end, label)
    return out.otherwise(SECTIONS[-1])


def document_order(paragraph: Column, anchor_order: Column, index: Column, parity: bool = True) -> list[Column]:
    """Sort key: paragraph if known, else the anchor's place, else the input's. With parity paragraph 0 counts as unknown."""
    known = F.when(paragraph > 0 if parity else paragraph >= 0, paragraph)
    return [F.coalesce(known, F.when(anchor_order >= 0, anchor_order), index), F.coalesce(anchor_order, F.lit(-1)), index]


def carry_forward(value: Column, keys: list[str], order: list[Column]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def prefix_before(stop: Column, order: Column, keys: list[str]) -> Column:
    """Whether a row stands before the first one where stop holds; all of them where none does."""
    first = F.min(F.when(stop, order)).over(Window.partitionBy(*keys))
    return first.isNull() | (order < first)


def running_best(value: Column, keys: list[str], order: list[Column], limit: float = 0.99) -> Column:
    """Progress that never goes back and stays below the limit."""
    return F.max(F.least(value, F.lit(limit))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def changed(value: Column, keys: list[str], order: list[Column]) -> Column:
    """Whether the value differs from the row before; a first row does."""
    return ~value.eqNullSafe(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))) | (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def numbered(prefix: Column, keys: list[str], order: list[Column]) -> Column:
    return F.concat(prefix, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string"))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def capped_top_k(rows: DataFrame, section: str, anchor: str, order: list[Column], per_anchor: int, caps: dict[str, int]) -> DataFrame:
    """At most per_anchor rows of a section's anchor, then the section's cap, both in the order; rank counts the kept ones."""
    first = top_k(rows, [section, anchor], order, per_anchor)
    cap = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)])
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(*order)))
    # the largest cap as a literal lets each task cut its part of a section before the exchange
    return ranked.where(F.col("rank") <= max(caps.values(), default=0)).where(F.col("rank") <= F.coalesce(cap[F.col(section)], F.lit(0)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


SORTS = {"updated_at", "created_at", "progress"}


def sort_columns(said: str, tie: str) -> list[Column]:
    """Columns for 'name:asc' or 'name:desc'; ValueError for anything else."""
    name, _, way = said.partition(":")
    if name not in SORTS or way not in ("asc", "desc"):
        raise ValueError(f"invalid_sort: {said}")
    return [F.col(name).asc() if way == "asc" else F.col(name).desc(), F.col(tie)]


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group in the order, as one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_wins(rows: DataFrame, keys: list[str | Column], order: list[Column], keep_null: str | None = None) -> DataFrame:
    """The first row of each key. Rows whose keep_null column is null all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__n", F.row_number().over(w))
    stay = F.col("__n") == 1
    return out.where(stay | F.col(keep_null).isNull() if keep_null else stay).drop("__n")


def retention(reports: DataFrame, keep: int, document: str, created: str, active: DataFrame | None = None) -> DataFrame:
    """Documents to prune: all but the newest `keep` (1 to 10) by their last report, without active ones."""
    keep = max(1, min(10, keep))
    last = reports.groupBy(document).agg(F.max(created).alias("newest"))
    kept = last.orderBy(F.desc("newest"), document).limit(keep).select(document)
    out = last.join(kept, document, "left_anti")
    return out.join(active.select(document).distinct(), document, "left_anti") if active is not None else out


def backfill(have: DataFrame, more: DataFrame, keys: list[str], item: str, order: list[Column], least: int) -> DataFrame:
    """Unseen candidates that bring each group to at least so many rows."""
    count = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    unseen = more.join(have.select(*keys, item).distinct(), [*keys, item], "left_anti")
    ranked = first_wins(unseen, [*keys, item], order).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(count, keys, "left").where(F.col("__r") <= F.lit(least) - F.coalesce("__have", F.lit(0))).drop("__r", "__have")


def ordered_refs(rows: DataFrame, key: str, order: str, refs: str, cap: int = 30) -> DataFrame:
    """A group's references in order of appearance, equal ones without case once, capped by the feature's limit."""
    each = rows.select(key, order, F.posexplode(refs).alias("__i", "ref"))
    first = first_wins(each.withColumn("__low", F.lower("ref")), [key, "__low"], [F.col(order), F.col("__i")])
    return first.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, "__i", "ref"))), 1, cap), lambda x: x["ref"]).alias("refs"))


def priority(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed list, last for what isn't in it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)), F.lit(len(order) + 1))


def media_order(kind: Column, supplementary: Column, label: Column, index: Column) -> list[Column]:
    """Figures before tables, main before supplementary, by number, then suffix."""
    n = F.regexp_extract(label, r"(\d+)", 1).try_cast("int")
    return [F.when(kind == "figure", 0).when(kind == "table", 1).otherwise(2) + F.when(supplementary, 10).otherwise(0), F.coalesce(n, F.lit(10**6)), index, F.lower(F.regexp_extract(label, r"\d+([A-Za-z]?)", 1)), label]
