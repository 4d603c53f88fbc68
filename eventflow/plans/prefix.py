"""Running aggregates and trailing frames over groups of any size.

A plain window function sends each group to one task. When a key, or the whole
table, is too large for that, the rows are range-partitioned by (key, order) so
that a large group is cut into consecutive slices, every slice is scanned on
its own, and what came before a slice is added afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.plans.sizes import slices_for
from eventflow.plans.skew import HOT_KEYS, hot_keys
from eventflow.session import pin

_SLICE = "__slice"
_BLOCK = "__block"
_POSITION = "__position"
_AT = "__at"
_ROW = "__row"

BLOCK_ROWS = 1_000_000

_TOTAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}

# How an earlier slice's value joins the value inside the slice. greatest and
# least skip nulls, so a missing carry leaves the value as it is.
_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda before, here: F.coalesce(before + here, here, before),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "min": F.least,
    "max": F.greatest,
}

_CARRY = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    aggs: dict[str, tuple[str, Column]],
    spread: bool | None = None,
    slices: int | None = None,
    derived: bool = False,
) -> DataFrame:
    """Add running aggregates per key, from the first row to the current one.

    ``aggs`` maps a new column to (kind, expression), kind being sum, count,
    min or max. ``order`` must be a total order inside a key. With ``spread``
    unset, hot keys and orders without a key are sliced whatever the size of the
    input; all other keys take a plain window. ``derived`` says that the input is
    costly to compute and should be written once rather than computed again.
    """
    keys = list(keys)
    first = order[0] if _counts_only(df, keys, order, aggs) else None
    order = [F.col(c) if isinstance(c, str) else c for c in order]

    def plain(rows: DataFrame) -> DataFrame:
        frame = _to_here(keys, order)
        return rows.withColumns(
            {name: _TOTAL[kind](value).over(frame) for name, (kind, value) in aggs.items()}
        )

    def sliced(rows: DataFrame) -> DataFrame:
        return _running_in_slices(rows, keys, order, aggs, slices)

    number = 1 if first is None or derived or spread is False else slices or slices_for(df)
    if number > 1:
        hot = _hot_groups(df, keys, number, spread)
        if not hot:
            return plain(df)
        bounds = _bounds(df, first, number)
        if bounds is not None:
            return _counts_in_ranges(df, keys, order, aggs, F.col(first), bounds, hot)
    return _by_group_size(df, keys, spread, derived, plain, sliced)


def _by_group_size(
    df: DataFrame,
    keys: list[str],
    spread: bool | None,
    derived: bool,
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Give groups that fit a task to ``plain`` and the others to ``sliced``.

    Groups are told apart by a hash of their key, so that null keys and several
    key columns need no special care; a collision only slices a small group too.
    """
    if spread is not None:
        return sliced(df) if spread else plain(df)
    rows = pin(df) if derived else df
    if not keys:
        return sliced(rows)
    group = F.xxhash64(*keys)
    hot = hot_keys(rows.select(group.alias("group")), "group")
    if not hot:
        return plain(rows)
    large = group.isin(hot)
    return plain(rows.where(~large)).unionByName(sliced(rows.where(large)))


def _running_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    aggs: dict[str, tuple[str, Column]],
    slices: int | None,
) -> DataFrame:
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(slices or slices_for(df), *by)
    sliced = pin(ranged.withColumn(_SLICE, F.spark_partition_id()))

    carry = _carried_in(sliced, keys, aggs)
    frame = _to_here([_SLICE, *keys], order)
    scanned = sliced.withColumns(
        {name: _TOTAL[kind](value).over(frame) for name, (kind, value) in aggs.items()}
    )
    # A key has rows in two slices only when a slice edge cuts it, so the carry
    # has fewer rows than there are slices, whatever the data: broadcast is bounded.
    same = F.lit(True)
    for name in [_SLICE, *keys]:
        same = same & F.col(name).eqNullSafe(F.col(_before(name)))
    joined = scanned.join(F.broadcast(carry), same, "left")
    return joined.select(
        *df.columns,
        *[
            _COMBINE[kind](F.col(_before(name)), F.col(name)).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def _counts_only(
    df: DataFrame, keys: list[str], order: Sequence[Column | str], aggs: dict[str, tuple[str, Column]]
) -> bool:
    """Whether these are counts per key, in an order that begins with a whole number."""
    known = keys and isinstance(order[0], str) and order[0] in df.columns
    whole = known and isinstance(df.schema[order[0]].dataType, T.IntegralType)
    return bool(whole) and all(kind == "count" for kind, _ in aggs.values())


def _hot_groups(df: DataFrame, keys: list[str], slices: int, spread: bool | None) -> list:
    """Hashes of the keys that hold more rows than a slice; unless all is to be spread, a hot key's number at least.

    There are no more of them than slices, so the sketch is small.
    """
    share = 1 / min(slices, HOT_KEYS)
    groups = df.select(F.xxhash64(*keys).alias("group"))
    return hot_keys(groups, "group", share, 1 if spread else None)


def _bounds(df: DataFrame, column: str, slices: int) -> list[float] | None:
    """Values that cut the rows into ranges of about the same size; None where they do not."""
    shares = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 10 * slices)).first()[0]
    # A value found twice holds a range's rows or more by itself.
    return None if not found or len(set(found)) < len(shares) else found


def _counts_in_ranges(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    aggs: dict[str, tuple[str, Column]],
    first: Column,
    bounds: list[float],
    hot: list,
) -> DataFrame:
    """Running counts where the rows of hot keys are cut into slices by the first column of the order.

    The slice of a row follows from the row, so nothing has to be written and rows are shuffled once. A group
    of one slice and key has no more rows than the slice. What earlier slices hold of a hot key comes
    as a row before all others of the key.
    """
    large = F.xxhash64(*keys).isin(hot)
    at = F.coalesce(first.cast("double"), F.lit(float("-inf")))  # nulls come first in the order too
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=_AT, outputCol=_SLICE)
    rows = cut.transform(df.withColumn(_AT, at)).drop(_AT)
    rows = rows.withColumn(_SLICE, F.when(large, F.col(_SLICE).cast("int")).otherwise(-1))
    carry = _carried_in(rows.where(large), keys, aggs).toDF(_SLICE, *keys, *[_before(name) for name in aggs])
    single = rows.withColumns(
        {_before(name): F.when(value.isNotNull(), 1).otherwise(0).cast("bigint") for name, (_, value) in aggs.items()}
    )
    both = single.withColumn(_ROW, F.lit(1)).unionByName(carry.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)
    frame = _to_here([_SLICE, *keys], [F.col(_ROW), *order])
    counted = {name: F.coalesce(F.sum(_before(name)).over(frame), F.lit(0).cast("bigint")) for name in aggs}
    return both.withColumns(counted).where(F.col(_ROW) == 1).select(*df.columns, *aggs)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    spread: bool | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, spread, slices)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    first: int,
    last: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    spread: bool | None = None,
    slices: int | None = None,
    block_rows: int = BLOCK_ROWS,
    derived: bool = False,
) -> DataFrame:
    """Evaluate ``columns`` over a frame of rows ``first..last`` (both <= 0).

    When spread, each key is cut into blocks of ``block_rows`` numbered rows and
    the last ``-first`` rows of a block are also given to the next one, so a
    task sees one block and the few rows before it.
    """
    if first > last or last > 0:
        raise ValueError("the frame must lie at or before the current row")
    keys = list(keys)
    reach = -first
    if block_rows < max(reach, 1):
        raise ValueError("block_rows must cover the frame")

    def plain(rows: DataFrame) -> DataFrame:
        by = [F.col(c) if isinstance(c, str) else c for c in order]
        frame = Window.partitionBy(*keys).orderBy(*by).rowsBetween(first, last)
        return rows.withColumns(columns(frame))

    def sliced(rows: DataFrame) -> DataFrame:
        numbered = with_position(rows, keys, order, _POSITION, True, slices)
        home = F.expr(f"({_POSITION} - 1) div {block_rows}")
        lent = F.pmod(F.col(_POSITION) - 1, F.lit(block_rows)) >= block_rows - reach
        blocks = F.when(lent, F.array(home, home + 1)).otherwise(F.array(home))
        frame = (
            Window.partitionBy(*keys, _BLOCK).orderBy(_POSITION).rowsBetween(first, last)
        )
        return (
            numbered.withColumn(_BLOCK, F.explode(blocks))
            .withColumns(columns(frame))
            .where(F.col(_BLOCK) == home)
            .drop(_BLOCK, _POSITION)
        )

    return _by_group_size(df, keys, spread, derived, plain, sliced)


def _to_here(keys: list[str], order: list[Column]) -> WindowSpec:
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _before(name: str) -> str:
    return f"__before_{name}"


def _carried_in(
    sliced: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]]
) -> DataFrame:
    """What earlier slices hold of each key, for the slices that continue one."""
    totals = sliced.groupBy(*keys, _SLICE).agg(
        *[_TOTAL[kind](value).alias(name) for name, (kind, value) in aggs.items()]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(_SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        totals.select(
            *[F.col(name).alias(_before(name)) for name in [_SLICE, *keys]],
            (F.count(F.lit(1)).over(earlier) > 0).alias("__continues"),
            *[
                _CARRY[kind](name).over(earlier).alias(_before(name))
                for name, (kind, _) in aggs.items()
            ],
        )
        .where("__continues")
        .drop("__continues")
    )
