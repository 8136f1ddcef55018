"""Time joins as lookups in disjoint spans.

Each helper turns the *reference* side (weather, labels, irrigation events) into spans
``[span_lo, span_hi]`` (microseconds, both ends included) that do not overlap within a key. A reading
then falls in at most one span, so ``span_lookup`` needs one equi-join on a time bucket with a range
condition: no candidate pairs come out and no second aggregation is needed. The bucketed spans are
written out first, so the planner knows their true size: it broadcasts them only below
``spark.sql.autoBroadcastJoinThreshold``, and the readings are then not shuffled at all. Above it both
sides are shuffled by bucket; the readings are the outer side, which adaptive skew handling can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.operators.ordered import HOUR, in_order, micros, neighbours, number_cell, time_cell
from fieldflow.session import cut_lineage

SECOND = 1_000_000
SPANS_PER_BUCKET = 256
BUCKET_COPIES = 32


def bucket_spans(spans: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """One row per span and time bucket it touches, with the keys renamed for a join."""
    steps = F.sequence(
        number_cell(F.col("span_lo"), width), number_cell(F.col("span_hi"), width), F.lit(width).cast("bigint")
    )
    return spans.withColumn("_k_bucket", F.explode(steps)).withColumnsRenamed({c: f"_k_{c}" for c in by})


def fitted_buckets(spans: DataFrame, by: Sequence[str], width: int) -> tuple[DataFrame, int]:
    """Written buckets and their width, narrowed while some bucket holds many spans.

    Narrow buckets repeat long spans; the width stays where the copies would outgrow the spans 32-fold.
    """
    while True:
        buckets = cut_lineage(bucket_spans(spans, by, width), "spans")
        keys = [f"_k_{c}" for c in by]
        fullest = buckets.groupBy(*keys, "_k_bucket").count().agg(F.max("count")).first()[0] or 0
        if fullest <= SPANS_PER_BUCKET:
            return buckets, width
        narrower = max(width >> (fullest // SPANS_PER_BUCKET).bit_length(), 1)
        n, length = spans.agg(F.count(F.lit(1)), F.sum(F.col("span_hi") - F.col("span_lo"))).first()
        if narrower == width or length / narrower > BUCKET_COPIES * n:
            return buckets, width
        width = narrower


def span_lookup(
    left: DataFrame,
    spans: DataFrame,
    by: Sequence[str] = (),
    ts: str = "ts",
    bucket_seconds: float = HOUR,
    how: str = "left",
) -> DataFrame:
    """Attach the columns of the span that holds ``ts``; null where none does (``how="left"``)."""
    right, width = fitted_buckets(spans, by, int(bucket_seconds * SECOND))
    keys = [f"_k_{c}" for c in by]
    probe = left.withColumn("_us", micros(ts)).withColumn("_bucket", number_cell(F.col("_us"), width))
    on = (F.col("_bucket") == F.col("_k_bucket")) & F.col("_us").between(F.col("span_lo"), F.col("span_hi"))
    for c, k in zip(by, keys):
        on = on & (probe[c] == F.col(k))
    return probe.join(right, on, how).drop("_us", "_bucket", "_k_bucket", "span_lo", "span_hi", *keys)


def nearest_spans(
    right: DataFrame, tolerance_seconds: float, by: Sequence[str] = (), ts: str = "ts", **cells
) -> DataFrame:
    """Span of times for which each row is the nearest one within the tolerance; a tie goes to the earlier row.

    ``ts`` is unique per key. The row's own time comes back as ``match_ts``.
    """
    tol = int(tolerance_seconds * SECOND)
    near = neighbours(
        right.withColumnRenamed(ts, "match_ts").withColumn("_t", micros("match_ts")),
        by,
        "match_ts",
        prev=["_t"],
        next=["_t"],
        **cells,
    )
    halfway = lambda other: F.shiftright(F.col("_t") + F.col(other), 1)
    return near.withColumns(
        {
            "span_lo": F.greatest(F.col("_t") - tol, halfway("prev__t") + 1),
            "span_hi": F.least(F.col("_t") + tol, halfway("next__t")),
        }
    ).drop("_t", "prev__t", "next__t")


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    tolerance_seconds: float,
    by: Sequence[str] = (),
    ts: str = "ts",
    bucket_seconds: float | None = None,
    **cells,
) -> DataFrame:
    """Left join to the nearest row of ``right`` within the tolerance."""
    spans = nearest_spans(right, tolerance_seconds, by, ts, **cells)
    return span_lookup(left, spans, by, ts, bucket_seconds or max(tolerance_seconds / 2, 1))


def coverage_spans(intervals: DataFrame, start: str, end: str, by: Sequence[str] = ("device_id",)) -> DataFrame:
    """Disjoint spans covered by at least one closed interval [start, end]; overlaps are merged by a sweep."""
    moves = intervals.select(
        *by,
        F.explode(
            F.array(
                F.struct(micros(start).alias("at"), F.lit(1).cast("bigint").alias("step")),
                F.struct((micros(end) + 1).alias("at"), F.lit(-1).cast("bigint").alias("step")),
            )
        ).alias("move"),
    )
    points = moves.groupBy(*by, F.col("move.at").alias("at")).agg(F.sum("move.step").alias("step"))
    spans = sweep(points, by, {"depth": F.col("step")})
    return spans.where("depth > 0").select(*by, "span_lo", "span_hi")


def sweep(
    points: DataFrame, by: Sequence[str], sums: dict[str, Column], lead: Sequence[str] = (), cell_seconds: float = HOUR
) -> DataFrame:
    """Running sums over change points ``at``; every point opens a span that ends just before the next one.

    ``lead`` columns are read from the next point as ``next_<name>``. The last span of a key is open
    and is left out: nothing changes after it.
    """
    day = int(24 * cell_seconds * SECOND)
    ordered = in_order(points, by, ["at"], number_cell(F.col("at"), day), sums, next=["at", *lead])
    return (
        ordered.where(F.col("next_at").isNotNull())
        .withColumn("span_hi", F.col("next_at") - 1)
        .withColumnRenamed("at", "span_lo")
        .drop("next_at")
    )


def contained_pairs(
    intervals: DataFrame, points: DataFrame, start: str, end: str, by: Sequence[str] = ("device_id",), ts: str = "ts"
) -> DataFrame:
    """Every (interval, point) with ``start <= ts < end`` on the same key: hour buckets, then the range."""
    width = HOUR * SECOND
    cut = intervals.withColumn(
        "_bucket",
        F.explode(F.sequence(time_cell(start, HOUR), number_cell(micros(end) - 1, width), F.lit(width).cast("bigint"))),
    )
    probe = points.withColumn("_bucket", time_cell(ts, HOUR))
    return cut.join(probe, [*by, "_bucket"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_bucket")
