"""Quantile groups of whole tables by cuts, without a sort of the rows.

Groups of equally many rows in a total order (a value, then a unique id) begin at positions
that follow from the number of rows. What has to be found is the row at each position:

1. A mergeable quantile sketch brackets the value there. An exact pass counts the rows below
   and inside the bracket; a bracket that misses its position is only narrowed as far as the
   counts prove. Brackets of more than ``FEW_ROWS`` rows are sketched again.
2. The rows per value inside the brackets give the exact value, and how many rows are before.
3. Rows with the same value are told apart by their ids, found in the same way.

All cuts of all orders share these passes. The group of a row is then an expression over a few
literals. NULL comes before all values, as in an ascending sort.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows in a bracket whose values are counted.
FEW_ROWS = 100_000
# One in so many rows is the error of a sketch.
ACCURACY = 2000
# Rounds of sketches after which brackets are counted whatever their size.
MOST_ROUNDS = 12


@dataclass(frozen=True)
class _Search:
    """The value at ``position`` among the rows that ``rows`` chooses."""

    rows: Column
    value: str
    position: int
    size: int  # rows inside the bracket
    before: int = 0  # rows below it
    low: Any = None
    high: Any = None

    def inside(self) -> Column:
        value = F.col(self.value)
        found = self.rows & value.isNotNull()
        if self.low is not None:
            found = found & (value >= F.lit(self.low))
        if self.high is not None:
            found = found & (value <= F.lit(self.high))
        return found


def _narrowed(df: DataFrame, searches: list[_Search]) -> list[_Search]:
    """Brackets from a sketch of what is inside, as far as exact counts confirm them."""
    sketches = []
    for n, s in enumerate(searches):
        at, margin = (s.position - s.before + 0.5) / s.size, 1.5 / ACCURACY
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        sketches.append(F.percentile_approx(F.when(s.inside(), F.col(s.value)), ends, ACCURACY).alias(f"s{n}"))
    ends = df.agg(*sketches).first()
    counts = []
    for n, s in enumerate(searches):
        low, high = ends[n]
        value, inside = F.col(s.value), s.inside()
        for name, found in (
            ("below_low", value < F.lit(low)), ("to_low", value <= F.lit(low)),
            ("below_high", value < F.lit(high)), ("to_high", value <= F.lit(high)),
        ):
            counts.append(F.count_if(inside & found).alias(f"{name}_{n}"))
    found = df.agg(*counts).first()
    out = []
    for n, s in enumerate(searches):
        (low, high), at = ends[n], s.position - s.before
        below_low, below_high = found[f"below_low_{n}"], found[f"below_high_{n}"]
        to_low, to_high = found[f"to_low_{n}"], found[f"to_high_{n}"]
        if at < below_low:
            out.append(replace(s, high=low, size=to_low))
        elif at >= to_high:
            out.append(replace(s, low=high, size=s.size - below_high, before=s.before + below_high))
        else:
            out.append(replace(s, low=low, high=high, size=to_high - below_low, before=s.before + below_low))
    return out


def _at_positions(df: DataFrame, searches: list[_Search], few_rows: int) -> list[tuple[Any, int, int]]:
    """(value at the position, rows before that value, rows with it) of each search."""
    for _ in range(MOST_ROUNDS):
        wide = [n for n, s in enumerate(searches) if s.size > few_rows and (s.low is None or s.low != s.high)]
        if not wide:
            break
        for n, s in zip(wide, _narrowed(df, [searches[n] for n in wide]), strict=True):
            searches[n] = s
    out = []
    for kind in sorted({s.value for s in searches}):
        mine = [(n, s) for n, s in enumerate(searches) if s.value == kind]
        which = F.array_compact(F.array(*[F.when(s.inside(), F.lit(n)) for n, s in mine]))
        per_value = (
            df.select(F.explode(which).alias("search"), F.col(kind).alias("value"))
            .groupBy("search", "value")
            .agg(F.count("*").alias("n"))
        )
        # At most FEW_ROWS rows of a search, but for brackets of one value, which are one row.
        upto = F.sum("n").over(Window.partitionBy("search").orderBy("value"))
        reached = F.element_at(
            F.create_map(*[x for n, s in mine for x in (F.lit(n), F.lit(s.position - s.before))]), F.col("search")
        )
        hit = per_value.withColumn("upto", upto).where(
            (F.col("upto") > reached) & (F.col("upto") - F.col("n") <= reached)
        )
        for row in hit.collect():
            s = searches[row.search]
            out.append((row.search, (row.value, s.before + row.upto - row.n, row.n)))
    return [found for _, found in sorted(out, key=lambda x: x[0])]


def _starts(rows: int, groups: int) -> list[int]:
    """Positions where groups 2, 3, ... begin; the first ones have a row more."""
    return [j * (rows // groups) + min(j, rows % groups) for j in range(1, groups)]


def add_groups(
    df: DataFrame, orders: dict[str, str], unique: str, groups: int, few_rows: int = FEW_ROWS
) -> DataFrame:
    """Adds one column per entry of ``orders``, the quantile group by a value, then by ``unique``.

    ``df`` is read several times, so it should be a written table. Groups are numbered from 1,
    as by ``ntile`` over the same order.
    """
    sizes = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"known_{name}") for name, c in orders.items()]).first()
    cuts: dict[tuple[str, int], Column] = {}
    searches, wanted = [], []
    id_searches, id_wanted = [], []
    for name, column in orders.items():
        known = sizes[f"known_{name}"]
        unknown = sizes.n - known
        for group, start in enumerate(_starts(sizes.n, groups), 2):
            if start >= sizes.n:
                cuts[name, group] = F.lit(False)
            elif start < unknown:
                id_searches.append(_Search(F.col(column).isNull(), unique, start, unknown))
                id_wanted.append((name, group, None))
            else:
                searches.append(_Search(F.lit(True), column, start - unknown, known))
                wanted.append((name, group))
    for (name, group), s, (value, before, ties) in zip(
        wanted, list(searches), _at_positions(df, searches, few_rows) if searches else [], strict=True
    ):
        column = F.col(orders[name])
        if s.position == before:
            cuts[name, group] = column >= F.lit(value)
        else:
            id_searches.append(_Search(column == F.lit(value), unique, s.position - before, ties))
            id_wanted.append((name, group, value))
    found = _at_positions(df, id_searches, few_rows) if id_searches else []
    for (name, group, value), (first, _, _) in zip(id_wanted, found, strict=True):
        column, later = F.col(orders[name]), F.col(unique) >= F.lit(first)
        if value is None:
            cuts[name, group] = column.isNotNull() | later
        else:
            cuts[name, group] = (column > F.lit(value)) | ((column == F.lit(value)) & later)
    added = {}
    for name in orders:
        group = F.lit(1)
        for j in range(2, groups + 1):
            group = group + F.coalesce(cuts[name, j], F.lit(False)).cast("int")
        added[name] = group
    return df.withColumns(added)
