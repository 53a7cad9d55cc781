"""Global order over a whole table without moving it into one task.

`row_number()`, `ntile()` and `percentile()` without a partition run in one task.  Tiles and quantiles
need a few order statistics only, which `rows_at` selects by counting.  To number all rows, they are range partitioned on a unique sort key, sorted, and numbered inside each
partition by `monotonically_increasing_id()`, whose upper bits are the partition and whose
lower 33 bits count its rows.  The result is staged, because another evaluation may sample
other range bounds.  Only the row count per partition is ever summed up in one place.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from fractions import Fraction
from functools import cmp_to_key, reduce
from math import floor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.staging import stage

_RUN_BITS = 33
_ID = "_position"


class SortKey(NamedTuple):
    name: str
    ascending: bool = True

    def column(self) -> Column:
        return F.col(self.name).asc_nulls_last() if self.ascending else F.col(self.name).desc_nulls_last()


def _keys(order: Iterable) -> list[SortKey]:
    return [SortKey(key) if isinstance(key, str) else SortKey(*key) for key in order]


def _sorted_runs(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    order = [key.column() for key in keys]
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_ID, F.monotonically_increasing_id())
    )
    return stage(numbered, "sorted")


def _run() -> Column:
    return F.shiftright(_ID, _RUN_BITS)


def number_rows(df: DataFrame, order, name: str = "row_number") -> DataFrame:
    """Add the 1-based position of every row in the total order.

    `order` lists column names or `(name, ascending)` pairs and must be unique per row.
    The broadcast side has one row per range partition.
    """
    runs = _sorted_runs(df, _keys(order)).withColumn("_run", _run())
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_run", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col(_ID).bitwiseAND(F.lit((1 << _RUN_BITS) - 1))
    return (
        runs.join(F.broadcast(offsets), "_run")
        .withColumn(name, (F.col("_offset") + local + 1).cast("long"))
        .drop(_ID, "_run", "_offset")
    )


def rows_at(
    df: DataFrame, order, pick: Callable[[int], Iterable[int]], weight: str | None = None
) -> tuple[int, dict[int, Row]]:
    """The order columns of the rows that hold chosen 0-based ranks, and the total number of ranks.

    `pick` maps the total to the wanted ranks: a handful, set by the caller's parameters and not by the
    data.  With `weight`, a row stands for that many equal rows.  Nothing is sorted, shuffled or written:
    sampled rows become pivots, one scan counts the rows before, at and between them, and only the gaps that
    hold a wanted rank are looked at again.  Each round shrinks them by about `_PIVOTS` / ranks, until
    `_FEW` rows are left to sort at once; equal rows are found at a pivot, however many there are.
    `df` must return the same rows in every job.  Of a numeric first key the values at the ranks are found first,
    so that only rows with these values are compared by the others.
    """
    keys = _keys(order)
    if isinstance(df.schema[keys[0].name].dataType, T.NumericType):
        return _by_first_value(df, keys, pick, weight)
    return _by_pivots(df, keys, pick, weight)


def _by_first_value(df, keys, pick, weight):
    first = keys[0].name
    units = F.lit(1) if weight is None else F.col(weight)
    total, known = df.agg(F.coalesce(F.sum(units.cast("long")), F.lit(0)), F.count(first) == F.count("*")).first()
    wanted = sorted(set(pick(total)))
    if not known or not wanted:
        return _by_pivots(df, keys, pick, weight)
    turned = (lambda r: r) if keys[0].ascending else (lambda r: total - 1 - r)
    _, values = values_at(df, [first], lambda _: [turned(r) for r in wanted], weight)[first]
    if any(v != v for v in values.values()):
        return _by_pivots(df, keys, pick, weight)
    chosen = sorted(set(values.values()), reverse=not keys[0].ascending)
    value = F.col(first).cast("double")
    counts = df.select(value.alias("_value"), units.cast("long").alias("_units"))
    lists = F.lit(chosen).cast("array<double>")
    own = {r[0]: r[1] for r in counts.filter(F.array_contains(lists, F.col("_value"))).groupBy("_value").agg(F.sum("_units")).collect()}
    before = [F.col("_value") < v if keys[0].ascending else F.col("_value") > v for v in chosen]
    ahead = counts.agg(*[F.coalesce(F.sum(F.when(c, F.col("_units"))), F.lit(0)) for c in before]).first()
    # Rank among the rows with a chosen value, by rank among all.
    place, skipped = {}, 0
    for v, start in zip(chosen, ahead):
        place.update({r: r - start + skipped for r in wanted if start <= r < start + own[v]})
        skipped += own[v]
    _, rows = _by_pivots(df.filter(F.array_contains(lists, value)), keys, lambda _: place.values(), weight)
    return total, {r: rows[at] for r, at in place.items()}


def _by_pivots(df, keys, pick, weight):
    names = [key.name for key in keys]
    units = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*names, units.cast("long").alias("_units"))
    total, left = rows.agg(F.coalesce(F.sum("_units"), F.lit(0)), F.count("*")).first()
    found: dict[int, Row] = {}
    # Open intervals between two rows (None is the end): rows in it, ranks before it, wanted ranks.
    gaps = [(None, None, left, 0, sorted(set(pick(total))))]
    while gaps := [gap for gap in gaps if gap[4]]:
        inside = rows.filter(reduce(Column.__or__, [_between(keys, low, high) for low, high, *_ in gaps]))
        if sum(gap[2] for gap in gaps) <= _FEW:
            _resolve(inside, keys, gaps, found)
            break
        sample = inside.select(*names).orderBy(F.rand(1)).limit(_PIVOTS)
        # The ends of the gaps are pivots too, so that no cell reaches from one gap into another.
        ends = [row for gap in gaps for row in gap[:2] if row is not None]
        pivots = list({_place(keys, row).obj: row for row in [*ends, *sample.collect()]}.values())
        pivots.sort(key=lambda row: _place(keys, row))
        counts = {row[0]: (row[1], row[2]) for row in _cells(inside, keys, pivots, sample.schema).collect()}
        gaps = [smaller for gap in gaps for smaller in _narrow(gap, keys, pivots, counts, found)]
    return total, found


# Rows that a round compares with, and rows that the driver sorts at the end.
_PIVOTS = 1024
_FEW = 4096


def _between(keys: Sequence[SortKey], low: Row | None, high: Row | None) -> Column:
    after = F.lit(True) if low is None else _after(keys, low)
    return after if high is None else after & _after([SortKey(k.name, not k.ascending) for k in keys], high)


def _cells(rows: DataFrame, keys: Sequence[SortKey], pivots: list[Row], schema) -> DataFrame:
    """Rows and ranks per cell: 2 p + 1 holds the rows equal to pivot p, 2 p those between it and the one before."""
    table = rows.sparkSession.createDataFrame([(p, *row) for p, row in enumerate(pivots)], _with_number(schema))
    listed = table.agg(F.sort_array(F.collect_list(F.struct("_p", *[F.col(key.name) for key in keys])))).scalar()

    def beyond(pivot: Column) -> Column:
        condition = F.lit(False)
        for key in reversed(keys):
            mine, bound = F.col(key.name), pivot[key.name]
            condition = ((mine > bound) if key.ascending else (mine < bound)) | ((mine == bound) & condition)
        return condition

    steps = F.lit([1 << k for k in reversed(range(len(pivots).bit_length()))])
    inside = rows.withColumn("_pivots", listed)
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when((at + s <= len(pivots)) & beyond(F.get("_pivots", at + s - 1)), at + s).otherwise(at),
    )
    placed = inside.withColumn("_at", place)
    same = reduce(Column.__and__, [F.col(k.name).eqNullSafe(F.get("_pivots", F.col("_at"))[k.name]) for k in keys])
    cell = 2 * F.col("_at") + F.when((F.col("_at") < len(pivots)) & same, 1).otherwise(0)
    return placed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("_units").alias("units"))


def _with_number(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("_p", T.IntegerType()), *schema.fields])


def _narrow(gap, keys, pivots, counts, found):
    """The gaps between pivots that hold wanted ranks; ranks that fall on a pivot are found."""
    low, high, _, before, wanted = gap
    places = [_place(keys, row) for row in pivots]
    first, last = _within(places, keys, low, high)
    smaller = []
    for p in range(first, last + 1):
        end = pivots[p] if p < last else high
        n, units = counts.get(2 * p, (0, 0))
        smaller.append((low, end, n, before, [r for r in wanted if before <= r < before + units]))
        before += units
        if p < last:
            units = counts[2 * p + 1][1]
            found.update({r: end for r in wanted if before <= r < before + units})
            before, low = before + units, end
    return smaller


def _resolve(rows: DataFrame, keys: Sequence[SortKey], gaps: list, found: dict[int, Row]) -> None:
    """Sorts the few rows that are left in the gaps."""
    names = [key.name for key in keys]
    left = sorted(rows.collect(), key=lambda row: _place(keys, row))
    places = [_place(keys, row) for row in left]
    for low, high, _, before, wanted in gaps:
        first, last = _within(places, keys, low, high)
        for row in left[first:last]:
            found.update({r: Row(**{n: row[n] for n in names}) for r in wanted if before <= r < before + row["_units"]})
            before += row["_units"]


def _within(places: list, keys, low: Row | None, high: Row | None) -> tuple[int, int]:
    """The range of sorted places strictly between two rows."""
    first = 0 if low is None else bisect_right(places, _place(keys, low))
    return first, len(places) if high is None else bisect_left(places, _place(keys, high))


def _place(keys: Sequence[SortKey], row: Row):
    """Compares as the engine does: strings by their bytes, NaN above all numbers."""
    return _ordered(tuple((_plain(row[key.name]), key.ascending) for key in keys))


def _plain(value):
    if isinstance(value, str):
        return value.encode()
    return (value != value, 0.0 if value != value else value) if isinstance(value, float) else value


def _compare(a, b) -> int:
    for (x, up), (y, _) in zip(a, b):
        if x != y:
            return (1 if x > y else -1) * (1 if up else -1)
    return 0


_ordered = cmp_to_key(_compare)


def _after(keys: Sequence[SortKey], row: Row) -> Column:
    """Does a row come strictly after `row` in the order?"""
    condition = F.lit(False)
    for key in reversed(keys):
        bound = F.lit(row[key.name])
        beyond = F.col(key.name) > bound if key.ascending else F.col(key.name) < bound
        condition = beyond | ((F.col(key.name) == bound) & condition)
    return condition


def bucket_by_last_rows(df_order, last_rows: Iterable[Row]) -> Column:
    """1 + the number of bucket ends that a row comes after."""
    keys = _keys(df_order)
    steps = [F.when(_after(keys, row), 1).otherwise(0) for row in last_rows]
    return reduce(Column.__add__, steps, F.lit(1)).cast("int")


def ntile_ends(total: int, buckets: int) -> list[int]:
    """0-based rank of the last row of every bucket but the last; empty buckets have none."""
    size, larger = divmod(total, buckets)
    ends = (bucket * size + min(bucket, larger) for bucket in range(1, buckets))
    return [end - 1 for end in ends if end > 0]


def ntile(df: DataFrame, order, buckets: int) -> Column:
    """`ntile(buckets) OVER (ORDER BY order)` as an expression for the rows of `df`.

    Bucket sizes follow SQL: the first `n % buckets` buckets hold one row more.  `df` should
    be staged, and its order unique and without nulls.
    """
    names = [key.name for key in _keys(order)]
    _, rows = rows_at(df.select(*names), order, lambda n: ntile_ends(n, buckets))
    return bucket_by_last_rows(order, rows.values())


def _exact(fraction) -> Fraction:
    return Fraction(fraction).limit_denominator(10**9)


def quantile_ranks(total: int, fractions: Sequence) -> list[int]:
    """The ranks between which the linearly interpolated quantiles lie."""
    if total == 0:
        return []
    lows = [floor(_exact(p) * (total - 1)) for p in fractions]
    return [rank for low in lows for rank in (low, min(low + 1, total - 1))]


def exact_quantiles(df: DataFrame, column: str, fractions: Sequence, weight: str | None = None) -> list:
    """Linearly interpolated quantiles of the non-null values, one per fraction; a row may stand for `weight` rows."""
    values = df.filter(F.col(column).isNotNull()).select(column, *([weight] if weight else []))
    total, found = values_at(values, [column], lambda n: quantile_ranks(n, fractions), weight)[column]
    return _interpolated(total, found, fractions)


def quantiles_of(df: DataFrame, columns: Sequence[str], fractions: Sequence) -> dict[str, list]:
    """The same for several numeric columns, selected together in the same scans."""
    picked = values_at(df, columns, lambda n: quantile_ranks(n, fractions))
    return {c: _interpolated(total, rows, fractions) for c, (total, rows) in picked.items()}


def values_at(df: DataFrame, columns: Sequence[str], pick: Callable[[int], Iterable[int]], weight: str | None = None) -> dict:
    """Per numeric column the number of its non-null values, and its values at the ranks that `pick` wants.

    With `weight`, a row stands for that many.  A round is one scan: tasks count their values, and note the least and the
    greatest, in `_SPLITS` cells of every interval that holds a wanted rank.  A cell whose ends are equal is a result, the
    others are the next intervals, cut down to their ends.  Doubles are cut by their bits, 64 of them, so ten rounds
    are enough for any values.
    """
    names = [f"_{i}" for i in range(len(columns))]
    units = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)], units.cast("long").alias("_units"))
    everything = [(i, _LEAST, _GREATEST) for i in range(len(columns))]
    ends = {i: (n, low, high) for i, n, low, high in _counted(rows, names, [(*e, 1) for e in everything])}
    totals = [ends.get(i, (0,))[0] for i in range(len(columns))]
    found: list[dict[int, float]] = [{} for _ in columns]
    # Intervals with ends that occur: column, keys of the ends, ranks before, wanted ranks.
    gaps = [(i, *ends[i][1:], 0, sorted(set(pick(totals[i])))) for i in sorted(ends)]
    while True:
        for i, low, high, _, wanted in gaps:
            if low == high:
                found[i].update({r: _double_of(low) for r in wanted})
        gaps = [gap for gap in gaps if gap[4] and gap[1] < gap[2]]
        if not gaps:
            break
        cells: dict[int, list] = {}
        for cell, n, low, high in _counted(rows, names, [(i, low, high, _SPLITS) for i, low, high, *_ in gaps]):
            cells.setdefault(cell // _SPLITS, []).append((low, high, n))
        smaller = []
        for number, (i, _, _, before, wanted) in enumerate(gaps):
            for low, high, n in sorted(cells[number]):
                smaller.append((i, low, high, before, [r for r in wanted if before <= r < before + n]))
                before += n
        gaps = [gap for gap in smaller if gap[4]]
    return {c: (totals[i], found[i]) for i, c in enumerate(columns)}


_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1
_SPLITS = 256  # cells per interval


def _key_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, NaN last; zeros are equal."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _GREATEST)


def _double_of(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(_GREATEST))).view(np.float64))


def _counted(rows: DataFrame, names: list[str], gaps: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Ranks, least and greatest key of the cells that are not empty; intervals of a column do not overlap."""
    splits = gaps[0][3]
    plans = []
    for i in range(len(names)):
        mine = sorted((low, high, number) for number, (column, low, high, _) in enumerate(gaps) if column == i)
        # A cell begins where the one before ends; the steps between are whole numbers beyond 64 bits.
        starts = [low + (high - low + 1) * k // splits for low, high, _ in mine for k in range(splits)]
        tops = np.repeat(np.array([high for _, high, _ in mine], np.int64), splits)
        plans.append((np.array(starts, np.int64), tops, [number * splits + k for *_, number in mine for k in range(splits)]))
    shared = rows.sparkSession.sparkContext.broadcast(plans)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(s), np.int64), np.full(len(s), _GREATEST), np.full(len(s), _LEAST)) for s, *_ in shared.value]
        for batch in batches:
            units = batch.column("_units").to_numpy(zero_copy_only=False)
            for name, (starts, tops, _), (n, low, high) in zip(names, shared.value, sums):
                column = batch.column(name)
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)) if column.null_count else slice(None)
                keys = _key_of(column.to_numpy(zero_copy_only=False)[known].astype(float))
                cell = np.searchsorted(starts, keys, side="right") - 1
                inside = cell >= 0
                inside &= keys <= tops[np.maximum(cell, 0)] if len(tops) else False
                cell, keys, weights = cell[inside], keys[inside], units[known][inside]
                np.add.at(n, cell, weights)
                np.minimum.at(low, cell, keys)
                np.maximum.at(high, cell, keys)
        for (_, _, numbers), (n, low, high) in zip(shared.value, sums):
            filled = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(numbers, np.int64)[filled]), pa.array(n[filled]), pa.array(low[filled]), pa.array(high[filled])],
                names=["cell", "n", "low", "high"],
            )

    cells = rows.mapInArrow(count, "cell long, n long, low long, high long").groupBy("cell")
    return [tuple(r) for r in cells.agg(F.sum("n"), F.min("low"), F.max("high")).collect()]


def _interpolated(total: int, values: dict[int, float], fractions: Sequence) -> list:
    if total == 0:
        return [None] * len(fractions)
    result = []
    for p in fractions:
        at = _exact(p) * (total - 1)
        low = floor(at)
        a, b = float(values[low]), float(values[min(low + 1, total - 1)])
        result.append(a + (b - a) * float(at - low))
    return result


def quantile_score(value: Column, inner_edges: Sequence[float]) -> Column:
    """1 + the number of edges below the value: right-closed quantile bins."""
    steps = [F.when(value > edge, 1).otherwise(0) for edge in inner_edges]
    return reduce(Column.__add__, steps, F.lit(1)).cast("int")


def inner_fractions(buckets: int) -> list[Fraction]:
    return [Fraction(i, buckets) for i in range(1, buckets)]


def rank_quantile_score(df: DataFrame, order, buckets: int) -> Column:
    """Quantile bins of the row number, as an expression for the rows of `df`.

    Row number `r` of `n` lies above the edge at fraction `p` when `r - 1 > p * (n - 1)`,
    so the bins end at the rows with 0-based rank `floor(p * (n - 1))`.
    """
    names = [key.name for key in _keys(order)]

    def ends(total):
        return [floor(p * (total - 1)) for p in inner_fractions(buckets)] if total else []

    total, rows = rows_at(df.select(*names), order, ends)
    return bucket_by_last_rows(order, [rows[end] for end in ends(total)])
