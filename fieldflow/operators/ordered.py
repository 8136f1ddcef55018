"""Ordered computations per key that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy("device_id")`` sends a whole device to one task. The helpers here cut
each key by time first and stitch the cells together through a small per-cell table:

* ``in_order``        running sums, previous and next row: rows are shuffled once, by (key, cell); what
                      lies before and after a cell comes from the per-cell table
* ``row_index``       position of every row in its key
* ``over_rows``       lag / lead / rolling frames, on chunks of equal row count with an exact halo; a
                      ``row_index`` column that is already there is used as it is, so number the rows once,
                      early, and carry the number through row-preserving steps
* ``over_time``     count, sum, mean and deviation over the last minutes, whatever the cadence
* ``exact_median``    median from value counts and their running sums

The per-cell table has one row per key and occupied cell, so its size follows the time span, not
the row count. ``cell_seconds`` should be small enough that one (key, cell) fits a task;
``fit_cell_seconds`` measures that.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldflow.session import cut_lineage

HOUR = 3600
CHUNK_ROWS = 8_192
CELL_ROWS = 2_000_000
FRAME_TASK_ROWS = 250_000
NO_CELL = -(2**63)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def time_cell(ts: str | Column, seconds: float) -> Column:
    """Start of the fixed-width time cell, in microseconds. ``ts`` is a timestamp."""
    return number_cell(micros(ts), int(seconds * 1_000_000))


def number_cell(value: Column, width: int) -> Column:
    return value - F.pmod(value, F.lit(width).cast("bigint"))


def fit_cell_seconds(
    df: DataFrame, by: Sequence[str], ts: str = "ts", start: int = HOUR, max_rows: int = CELL_ROWS
) -> float:
    """Halve the cell width until the fullest (key, cell) holds at most ``max_rows`` rows.

    One aggregation over two columns per step; a step is only taken when a hot cell was seen. Rows of one
    instant cannot be told apart by time: a cell of them that stays too full is reported.
    """
    width, fullest = float(start), None
    while width > 0.001:
        fullest = (
            df.groupBy(*by, time_cell(ts, width).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.max("_n"))
            .first()[0]
        )
        if not fullest or fullest <= max_rows:
            break
        width /= 2 ** max(1, (fullest // max_rows).bit_length())
    else:
        warnings.warn(f"{fullest} rows share a key and a millisecond; {max_rows} were asked for", stacklevel=2)
    return max(width, 0.001)


def in_order(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cell: Column,
    sums: dict[str, Column] | None = None,
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
    descending: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Running sums (the current row included), ``prev_<c>`` and ``next_<c>`` in the order of each key.

    ``cell`` must be monotone in ``order``, which is total where ``prev`` and ``next`` are asked for. No row
    is lost: a null key is a key of its own, and rows with a null cell come before all others of their key
    (after them if ``descending``). ``tasks`` fixes into how many tasks the (key, cell) groups are dealt; without
    it the session does, by bytes.
    """
    sums = sums or {}
    # Struct and cell are never null, so window and join share one plain shuffle and keep rows with null keys.
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    first = F.coalesce(cell.cast("bigint"), F.lit(NO_CELL))
    cells = df.withColumns({"_key": key, "_cell": first} | {f"_v_{n}": c for n, c in sums.items()})
    at = F.struct(*order)
    by = ["_key"]
    low, high = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    parts = [F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums]
    parts += [high(c, at).alias(f"_last_{c}") for c in prev] + [low(c, at).alias(f"_first_{c}") for c in next]
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    across = Window.partitionBy(*by).orderBy(direction("_cell"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    stitches = cells.groupBy(*by, "_cell").agg(*(parts or [F.count(F.lit(1)).alias("_n")])).select(
        *by,
        "_cell",
        *[F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.lag(f"_last_{c}").over(across).alias(f"_before_cell_{c}") for c in prev],
        *[F.lead(f"_first_{c}").over(across).alias(f"_after_cell_{c}") for c in next],
    )
    within = Window.partitionBy(*by, "_cell").orderBy(*[direction(c) for c in order])
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_in_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
    local |= {f"_prev_{c}": F.lag(c).over(within) for c in prev} | {f"_next_{c}": F.lead(c).over(within) for c in next}
    if prev:
        local["_opens"] = F.lag(F.lit(1)).over(within).isNull()
    if next:
        local["_closes"] = F.lead(F.lit(1)).over(within).isNull()
    dealt = cells.repartition(tasks, *by, "_cell") if tasks else cells
    joined = dealt.withColumns(local).join(stitches, [*by, "_cell"])
    out = joined.withColumns(
        {n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in sums}
        | {f"prev_{c}": F.when(F.col("_opens"), F.col(f"_before_cell_{c}")).otherwise(F.col(f"_prev_{c}")) for c in prev}
        | {f"next_{c}": F.when(F.col("_closes"), F.col(f"_after_cell_{c}")).otherwise(F.col(f"_next_{c}")) for c in next}
    )
    return out.select(*[c for c in out.columns if c in df.columns or c in sums or c in [f"prev_{x}" for x in prev] + [f"next_{x}" for x in next]])


def neighbours(
    df: DataFrame,
    by: Sequence[str] = ("device_id",),
    ts: str = "ts",
    cell_seconds: float | None = None,
    then: Sequence[str] = (),
    **wanted,
) -> DataFrame:
    """``in_order`` by a timestamp column, cut into time cells, measured on ``df`` if no width is given.

    ``then`` orders rows of one instant.
    """
    return in_order(df, by, [ts, *then], time_cell(ts, cell_seconds or fit_cell_seconds(df, by, ts)), **wanted)


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str] = ("ts",),
    name: str = "row_index",
    cell_seconds: float | None = None,
) -> DataFrame:
    """1-based position of each row within its key. ``order[0]`` is a timestamp; order must be total.

    Without a width the cells are measured on ``df``: pass one on where it is known.
    """
    width = cell_seconds or fit_cell_seconds(df, by, order[0])
    return in_order(df, by, order, time_cell(order[0], width), {name: F.lit(1).cast("bigint")})


def number_rows(df: DataFrame, by: Sequence[str] = ("device_id",), ts: str = "ts") -> DataFrame:
    """``row_index`` with cells measured on ``df`` first: no (key, cell) holds more than ``CELL_ROWS`` rows."""
    return row_index(df, by, (ts,))


def over_rows(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    by: Sequence[str] = ("device_id",),
    order: Sequence[str] = ("ts",),
    before: int = 0,
    after: int = 0,
    cell_seconds: float | None = None,
    chunk_rows: int = CHUNK_ROWS,
    keep_index: bool = False,
) -> DataFrame:
    """Evaluate row-frame window columns that reach at most ``before`` rows back and ``after`` ahead.

    Rows are grouped in chunks of exactly ``chunk_rows`` positions; the last ``before`` rows of a chunk
    also go to the next one and the first ``after`` rows to the previous one, so each frame is whole.
    ``row_index`` is kept if it came in or if ``keep_index`` asks for it.
    """
    if max(before, after) > chunk_rows:
        raise ValueError("chunk_rows must cover the frame")
    numbered = "row_index" in df.columns
    indexed = df if numbered else row_index(df, by, order, "row_index", cell_seconds)
    size = F.lit(chunk_rows).cast("bigint")
    inside = F.pmod(F.col("row_index") - 1, size)
    own = F.col("row_index") - 1 - inside
    targets = [own]
    if before:
        targets.append(F.when(inside >= chunk_rows - before, own + size))
    if after:
        targets.append(F.when(inside < after, own - size))
    chunked = indexed.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
    window = Window.partitionBy(*by, "_chunk").orderBy("row_index")
    out = chunked.withColumns(columns(window)).where(F.col("_chunk") == own).drop("_chunk")
    return out if numbered or keep_index else out.drop("row_index")


def over_time(
    df: DataFrame,
    columns: Sequence[str],
    minutes: Sequence[int],
    by: Sequence[str] = ("device_id",),
    ts: str = "ts",
    digits: int = 6,
    cell_seconds: float | None = None,
) -> DataFrame:
    """``<c>_n<m>m``, ``_sum<m>m``, ``_mean<m>m`` and ``_std<m>m`` over the last ``m`` minutes, for any cadence.

    A frame is [ts - m minutes, ts] and holds all rows of the key at its ends, those of the same instant too, as a
    RANGE frame does. Its sums are the running sums up to ``ts`` less those before the frame: each instant sends one
    mark per frame to the place just before it, so the work is the same for a frame of ten rows and one of a million.
    Values count in units of 10^-``digits`` and sums are exact whole numbers: no digits are lost to the difference,
    and results do not depend on partitioning. Nulls and NaN are left out of a frame (count 0, the rest null; ``std``
    needs two values). A row without a time has count 0; a null key is a key.

    Marks are wide and pack well, so tasks are cut by their number, not by shuffled bytes: about ``FRAME_TASK_ROWS`` each.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))
    keyed = df.withColumns({"_key": key, "_at": micros(ts)})
    unit = lambda c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) * F.lit(10.0**digits)).cast("decimal(19,0)")
    whole = "decimal(38,0)"
    parts = {}
    for i, c in enumerate(columns):
        parts |= {f"_n{i}": F.count(unit(c)), f"_s{i}": F.sum(unit(c)), f"_q{i}": F.sum(unit(c) * unit(c))}
    instants = keyed.where("_at is not null").groupBy("_key", "_at").agg(
        *[F.coalesce(v, F.lit(0)).cast(whole).alias(n) for n, v in parts.items()]
    )
    reach = F.array(F.lit(None).cast("bigint"), *[F.lit(m * 60 * 1_000_000).cast("bigint") for m in minutes])
    marked = cut_lineage(instants.withColumn("_back", F.explode(reach)), "frame-marks").withColumns(
        {"_own": F.col("_at"), "_row": F.col("_back").isNull()}
    )
    marked = marked.withColumn("_at", F.col("_at") - F.coalesce("_back", F.lit(0)))
    marked = marked.withColumn("_when", F.timestamp_micros("_at"))
    width = cell_seconds or fit_cell_seconds(marked, ["_key"], "_when", max_rows=FRAME_TASK_ROWS)
    tasks = marked.count() // FRAME_TASK_ROWS + 1
    sums = {f"_to{n}": F.when(F.col("_row"), F.col(n)).otherwise(F.lit(0).cast(whole)) for n in parts}
    # A mark stands before the rows of its instant: false sorts first.
    running = in_order(marked.withColumnRenamed("_key", "_k"), ["_k"], ["_at", "_row"], time_cell("_when", width), sums, tasks=tasks)
    pick = lambda n, back: F.max(F.when(F.col("_back").eqNullSafe(back), F.col(f"_to{n}")))
    frames = running.repartition(tasks, "_k", "_own").groupBy(F.col("_k").alias("_key"), F.col("_own").alias("_at")).agg(
        *[pick(n, F.lit(None)).alias(f"_upto{n}") for n in parts],
        *[pick(n, F.lit(m * 60 * 1_000_000)).alias(f"_m{m}{n}") for m in minutes for n in parts],
    )
    out = {}
    for m in minutes:
        for i, c in enumerate(columns):
            n, s, q = (F.col(f"_upto_{x}{i}") - F.col(f"_m{m}_{x}{i}") for x in "nsq")
            some = n > 0
            spread = (n * q - s * s).cast("double") / (n * (n - 1)).cast("double")
            out |= {
                f"{c}_n{m}m": F.coalesce(n.cast("bigint"), F.lit(0)),
                f"{c}_sum{m}m": F.when(some, s.cast("double") / 10.0**digits),
                f"{c}_mean{m}m": F.when(some, s.cast("double") / n.cast("double") / 10.0**digits),
                f"{c}_std{m}m": F.when(n > 1, F.sqrt(spread) / 10.0**digits),
            }
    return keyed.join(frames, ["_key", "_at"], "left").select(*df.columns, *[v.alias(k) for k, v in out.items()])


def exact_median(df: DataFrame, by: Sequence[str], value: str, cell_width: int = 1_000_000) -> DataFrame:
    """Median of an integer column per key, without holding a key's values in one buffer.

    Output: keys, ``n`` and ``median``. Works on value counts, which shrink map-side.
    """
    counts = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), "value-counts"
    )
    ranked = in_order(
        counts, by, [value], number_cell(F.col(value).cast("bigint"), cell_width), {"_cum": F.col("_c")}
    )
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    if by:
        sized = ranked.join(cut_lineage(totals, "totals"), list(by))
    else:
        sized = ranked.withColumn("n", totals.scalar())
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    middle = sized.where((F.col("_cum") >= low) & (F.col("_cum") - F.col("_c") < high))
    return middle.groupBy(*by, "n").agg(((F.min(value) + F.max(value)) / 2).alias("median"))
