"""Class balance, splits, and evaluation of rain scores and amounts.

Rank metrics first reduce the rows to one per distinct score; running totals over score cells then give
the curve, so no window runs over the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.operators.ordered import CELL_ROWS, exact_median, fit_cell_seconds, in_order, over_rows, row_index
from fieldflow.operators.spans import asof_nearest
from fieldflow.session import cut_lineage

SWEEP = [0.1 + i * ((0.9 - 0.1) / 32) for i in range(33)]


def _ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den != 0, den))


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    pos, neg = F.sum((F.col(y) == 1).cast("bigint")), F.sum((F.col(y) == 0).cast("bigint"))
    weight = neg / F.greatest(pos, F.lit(1))
    return df.agg(
        pos.alias("pos"),
        neg.alias("neg"),
        weight.alias("scale_pos_weight"),
        F.greatest(F.lit(8.5), weight * 1.2).alias("scale_pos_weight_adjusted"),
    )


def prevalence(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    """Share of positives overall and in validation, and the F1 of predicting all zeros (always 0)."""
    held = F.col(split) == "validation"
    return df.agg(
        F.avg(y).alias("prevalence"),
        F.avg(F.when(held, F.col(y))).alias("validation_prevalence"),
        F.sum(F.col(y)).cast("bigint").alias("positives"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("all_zero_f1", F.lit(0.0))


def target_stats(df: DataFrame, target: str = "rain_amount_next_60_mm") -> DataFrame:
    """Min, max, mean, median and non-zero share of the target clipped at 0."""
    clipped = df.select(F.greatest(F.col(target), F.lit(0.0)).alias("v"))
    scaled = clipped.select("v", F.round(F.col("v") * 1_000_000).cast("bigint").alias("u"))
    median = exact_median(scaled, [], "u").select("median").scalar()
    return clipped.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("min_mm"),
        F.max("v").alias("max_mm"),
        F.avg("v").alias("mean_mm"),
        F.avg((F.col("v") > 0).cast("double")).alias("nonzero_share"),
    ).withColumn("median_mm", median / 1_000_000)


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (of each key), written once: the rows themselves are read a single time.

    Rows without a score or a label cannot be ranked and take no part, here and in every rate made from these.
    """
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    return cut_lineage(
        known.groupBy(*by, p).agg(
            F.sum(F.col(y)).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg")
        ),
        "score-counts",
    )


def score_cell(counts: DataFrame, p: str, max_rows: int) -> Column:
    """A cell number that ascends with the score; cells hold about ``max_rows`` distinct scores however they crowd.

    The edges are quantiles of the distinct scores, from a mergeable sketch.
    """
    cells = counts.count() // max_rows + 1
    if cells == 1:
        return F.lit(0)
    shares = [i / cells for i in range(1, cells)]
    edges = sorted(set(counts.agg(F.percentile_approx(p, shares, 10 * cells)).first()[0]))
    return F.size(F.filter(F.lit(edges), lambda e: e <= F.col(p)))


def curve_of(counts: DataFrame, p: str = "p", max_rows: int = CELL_ROWS) -> DataFrame:
    """Adds the positives and negatives at or above each score (``tp``, ``fp``)."""
    cell = score_cell(counts, p, max_rows)
    return in_order(counts, [], [p], cell, {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)


def score_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return curve_of(score_counts(df, y, p), p)


def auc_roc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Chance that a positive scores above a negative; ties count half."""
    curve = score_curve(df, y, p)
    positives, negatives = F.sum("pos"), F.sum("neg")
    above = F.col("fp") - F.col("neg")
    beaten_by = F.sum(F.col("pos") * (above + F.col("neg") / 2))
    return curve.agg(
        (1 - _ratio(beaten_by, (positives * negatives).cast("double"))).alias("auc_roc"),
        positives.alias("positives"),
        negatives.alias("negatives"),
    )


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    curve = score_curve(df, y, p)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.agg(_ratio(F.sum(F.col("pos") * precision), F.sum("pos").cast("double")).alias("average_precision"))


def rank_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """``auc_roc`` and ``average_precision`` of every key, from one curve over (key, distinct score).

    Cells are cut over all keys' scores, so none holds more than ``CELL_ROWS`` rows, be it one key's or many keys'.
    A key without positives or without negatives has null for what it cannot tell.
    """
    counts = score_counts(df, y, p, by)
    curve = in_order(counts, by, [p], score_cell(counts, p, CELL_ROWS), {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    positives, negatives = F.sum("pos"), F.sum("neg")
    beaten_by = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.groupBy(*by).agg(
        (1 - _ratio_or_null(beaten_by, positives * negatives)).alias("auc_roc"),
        _ratio_or_null(F.sum(F.col("pos") * precision), positives).alias("average_precision"),
        positives.alias("positives"),
        negatives.alias("negatives"),
    )


#: Distinct scores of one position in a cell of ``auc_per_position``, about, and rows whose equal scores are put together first.
POSITION_CELL, POSITION_ROWS = 500_000, 2**16 - 1


def auc_per_position(df: DataFrame, some: DataFrame, total: int, size: int, y: str = "y", scores: str = "scores") -> list[float | None]:
    """AUC of each of the ``size`` positions of an array of scores, as ``auc_roc`` of each alone; None where a class has no row.

    Scores are put together and sorted as arrays, cell by cell, instead of one row per score. ``some`` are rows whose
    quantiles part the ``total`` rows' scores into cells: they decide how even cells are and nothing else. Rows without a
    label or a score take no part.
    """
    plain = lambda of: of.select(F.col(y).cast("int").alias("y"), F.col(scores).cast("array<double>").alias("scores"))
    rows, cells = plain(df.where(F.col(y).isNotNull())), -(-total // POSITION_CELL)
    edges = [np.empty(0)] * size
    if cells > 1:
        drawn = plain(some).toArrow()["scores"].to_pylist()
        for i in range(size):
            known = [r[i] for r in drawn if r is not None and len(r) > i and r[i] is not None and not np.isnan(r[i])]
            edges[i] = np.unique(np.quantile(known, np.arange(1, cells) / cells)) if known else edges[i]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, POSITION_ROWS - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == POSITION_ROWS:
                    yield put_together(held)
                    held, n = [], 0
        if n:
            yield put_together(held)

    def put_together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        label, lists = table["y"].to_numpy() == 1, table["scores"].combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = lists.value_lengths().fill_null(0).to_numpy()
        starts = np.cumsum(lengths) - lengths
        out = []
        for i in range(size):
            has = np.flatnonzero(lengths > i)
            found = values.take(starts.take(has) + i)
            known = np.flatnonzero(~np.isnan(found))
            distinct, place = np.unique(found.take(known), return_inverse=True)
            positive = label.take(has.take(known))
            pos, neg = (np.bincount(place[of], minlength=len(distinct)).astype(np.uint16) for of in (positive, ~positive))
            ends = [0, *np.searchsorted(distinct, edges[i], "left"), len(distinct)]
            for cell, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a:
                    out.append((i, cell, distinct[a:b].tobytes(), pos[a:b].tobytes(), neg[a:b].tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    def rank(key, table):
        joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        distinct, place = np.unique(joined("scores", np.float64), return_inverse=True)
        pos, neg = (np.bincount(place, joined(c, np.uint16), len(distinct)).astype(np.int64) for c in ("pos", "neg"))
        halves = int((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum())
        return pa.table({"i": [key[0].as_py()], "cell": [key[1].as_py()], "pos": [int(pos.sum())], "neg": [int(neg.sum())], "halves": [halves]})

    schema = pa.schema([("i", pa.int32()), ("cell", pa.int32()), ("scores", pa.binary()), ("pos", pa.binary()), ("neg", pa.binary())])
    parts = rows.mapInArrow(cut, "i int, cell int, scores binary, pos binary, neg binary")
    ranked = parts.groupBy("i", "cell").applyInArrow(rank, "i bigint, cell bigint, pos bigint, neg bigint, halves bigint")
    seen = [[0, 0, 0] for _ in range(size)]
    for r in sorted(ranked.collect(), key=lambda r: (r.i, r.cell)):  # one row per position and cell
        positives, negatives, halves = seen[r.i]
        seen[r.i] = [positives + r.pos, negatives + r.neg, halves + r.halves + 2 * r.pos * negatives]
    return [halves / (2 * positives * negatives) if positives and negatives else None for positives, negatives, halves in seen]


def _ratio_or_null(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom.cast("double"))


def pr_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision and recall with every observed score as threshold."""
    counts = score_counts(df, y, p)
    curve = curve_of(counts, p)
    positives = counts.select(F.sum("pos")).scalar()
    return curve.select(
        F.col(p).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), positives.cast("double")).alias("recall"),
    ).withColumn(
        "f1",
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12),
    )


def _best(points: DataFrame, by: str) -> DataFrame:
    """Row with the highest value; the lowest threshold wins a tie."""
    return points.agg(
        F.max_by(
            F.struct("threshold", "precision", "recall", "f1"), F.struct(F.round(by, 12), -F.col("threshold"))
        ).alias("b")
    ).select("b.*")


def best_f1(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return _best(pr_points(df, y, p), "f1")


def recall_first(df: DataFrame, target_recall: float = 0.60, y: str = "y", p: str = "p") -> DataFrame:
    """Highest precision among thresholds that reach the recall; else the best F1's threshold; else 0.5."""
    points = pr_points(df, y, p)
    reaching = F.when(F.col("recall") >= target_recall, F.round("precision", 12))
    order = lambda v: F.struct(v, -F.col("threshold"))
    return points.agg(
        F.max_by("threshold", F.when(reaching.isNotNull(), order(reaching))).alias("by_recall"),
        F.max_by("threshold", order(F.round("f1", 12))).alias("by_f1"),
    ).select("by_recall", "by_f1", F.coalesce("by_recall", "by_f1", F.lit(0.5)).alias("default_threshold"))


def _scores(threshold: Column, tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision, recall = _ratio(tp, (tp + fp).cast("double")), _ratio(tp, (tp + fn).cast("double"))
    return [
        threshold.alias("threshold"),
        _ratio(tp + tn, (tp + fp + fn + tn).cast("double")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, (2 * tp + fp + fn).cast("double")).alias("f1"),
        tp.alias("tp"),
        fp.alias("fp"),
        tn.alias("tn"),
        fn.alias("fn"),
    ]


def metrics_at(df: DataFrame, thresholds: Sequence[float | Column], y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts and scores per distinct threshold, from one pass. A threshold may be a one-row subquery."""
    marked = df.withColumn("_ths", F.array(*[t if isinstance(t, Column) else F.lit(float(t)) for t in thresholds]))
    hits, out = [], []
    for i in range(len(thresholds)):
        yes = F.col(p) >= F.col("_ths")[i]
        one = F.col(y) == 1
        for name, cond in (("tp", one & yes), ("fp", ~one & yes), ("fn", one & ~yes), ("tn", ~one & ~yes)):
            hits.append(F.sum(cond.cast("bigint")).alias(f"{name}{i}"))
        out.append(F.struct(F.col("_ths")[i].alias("t"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]))
    one_row = marked.agg(F.first("_ths").alias("_ths"), *hits)
    rows = one_row.select(F.explode(F.array_distinct(F.array(*out))).alias("r"))
    return rows.select(*_scores(*[F.col(f"r.{c}") for c in ("t", "tp", "fp", "fn", "tn")]))


def threshold_sweep(df: DataFrame, grid: Sequence[float] = SWEEP, y: str = "y", p: str = "p") -> DataFrame:
    """Scores at each grid threshold, with the first best F1 marked.

    Each row falls in one bin (how many thresholds it reaches); the grid's totals are suffix sums over
    those bins, so the rows are read once and only bins are shuffled.
    """
    grid_array = F.array(*[F.lit(float(t)) for t in grid])
    reached = sum((F.col("_p") >= float(t)).cast("int") for t in grid)
    bins = (
        df.select(F.col(p).alias("_p"), F.col(y).alias("_y"))
        .withColumn("bin", reached)
        .groupBy("bin")
        .agg(F.sum("_y").cast("bigint").alias("pos"), F.sum(1 - F.col("_y")).cast("bigint").alias("neg"))
    )
    table = bins.agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("b"))
    total = lambda field, keep: F.aggregate(
        F.filter("b", keep), F.lit(0).cast("bigint"), lambda a, x: a + x[field]
    )
    rows = table.select("b", F.posexplode(grid_array).alias("i", "threshold"))
    at = rows.select(
        "threshold",
        total("pos", lambda x: x["bin"] > F.col("i")).alias("tp"),
        total("neg", lambda x: x["bin"] > F.col("i")).alias("fp"),
        total("pos", lambda x: x["bin"] <= F.col("i")).alias("fn"),
        total("neg", lambda x: x["bin"] <= F.col("i")).alias("tn"),
    )
    return at.select(*_scores(*[F.col(c) for c in ("threshold", "tp", "fp", "fn", "tn")]))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold"))).alias("b")).select("b.*")


def class_report(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per class, with the plain and the support-weighted mean."""
    m = metrics_at(df, [threshold], y, p)
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]

    def line(name, a, b, c):
        return F.struct(
            F.lit(name).alias("label"),
            _ratio(a, (a + b).cast("double")).alias("precision"),
            _ratio(a, (a + c).cast("double")).alias("recall"),
            _ratio(2 * a, (2 * a + b + c).cast("double")).alias("f1"),
            (a + c).alias("support"),
        )

    classes = m.select(line("0", tn, fn, fp).alias("c0"), line("1", tp, fp, fn).alias("c1"))
    n = F.col("c0.support") + F.col("c1.support")
    mean = lambda f: (F.col(f"c0.{f}") + F.col(f"c1.{f}")) / 2
    weighted = lambda f: _ratio(
        F.col(f"c0.{f}") * F.col("c0.support") + F.col(f"c1.{f}") * F.col("c1.support"), n.cast("double")
    )
    fields = ("precision", "recall", "f1")
    lines = F.array(
        F.col("c0"),
        F.col("c1"),
        F.struct(F.lit("macro avg").alias("label"), *[mean(f).alias(f) for f in fields], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[weighted(f).alias(f) for f in fields], n.alias("support")),
    )
    return classes.select(F.explode(lines).alias("r")).select("r.*")


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R² of predictions clipped at 0. R² uses sums that combine in one pass."""
    a, p = F.greatest(F.col(actual), F.lit(0.0)), F.greatest(F.col(predicted), F.lit(0.0))
    residual = F.sum((a - p) * (a - p))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        (1 - residual / (F.var_pop(a) * F.count(F.lit(1)))).alias("r2"),
    )


def error_by_band(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    a, p = F.greatest(F.col(actual), F.lit(0.0)), F.greatest(F.col(predicted), F.lit(0.0))
    band = F.when(a < 2, "small").when(a < 5, "medium").otherwise("large")
    return df.groupBy(band.alias("rain_band")).agg(F.avg(F.abs(a - p)).alias("mae"), F.count(F.lit(1)).alias("n"))


def label_lag_corr(df: DataFrame, y: str = "y", x: str = "rain_in_last_15m", rows: int = 3, **cells) -> DataFrame:
    """Correlation of the label with recent rain, now and with the label taken ``rows`` ahead (per device)."""
    shifted = over_rows(df, lambda w: {"_ahead": F.lead(y, rows).over(w)}, after=rows, **cells)
    seen = F.col("_ahead").isNotNull()
    return shifted.agg(
        F.corr(y, x).alias("corr_now"),
        F.corr(F.when(seen, F.col("_ahead")), F.when(seen, F.col(x))).alias("corr_shifted"),
    )


def time_split(df: DataFrame, share: float = 0.15, order: Sequence[str] = ("ts", "device_id")) -> DataFrame:
    """The latest ``ceil(share * n)`` rows are the validation part; the rest, in time order, trains.

    Rows without a time count as the earliest.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    cut = n - F.ceil(n * F.lit(share))
    cell_seconds = fit_cell_seconds(df, [], order[0])
    return row_index(df, [], order, "_i", cell_seconds).withColumn(
        "split", F.when(F.col("_i") <= cut, "train").otherwise("validation")
    ).drop("_i")


def key_fraction(keys: Sequence[str]) -> Column:
    """A stable number in [0, 1) from the key's digest."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(2**32)


def stratified_split(
    df: DataFrame, keys: Sequence[str], share: float = 0.15, y: str | None = "y", max_rows: int = CELL_ROWS
) -> DataFrame:
    """Of each class the ``ceil(share * n)`` rows with the smallest key digests are the validation part.

    Digests spread evenly, so cells of equal digest ranges hold about ``max_rows`` rows of a class. Rows
    without a label are a class. Without a class column (or with ``y=None``) all rows are drawn from alike.
    """
    y = y if y in df.columns else None
    by = [y] if y else []
    sizes = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    cells = (sizes.agg(F.max("_n")).first()[0] or 0) // max_rows + 1
    drawn = df.withColumn("_digest", key_fraction(keys))
    order = ["_digest", *[k for k in keys if k not in by]]
    placed = in_order(drawn, by, order, F.floor(F.col("_digest") * cells), {"_i": F.lit(1).cast("bigint")})
    if y:
        counted = sizes.withColumnRenamed(y, "_class")
        placed = placed.join(counted, F.col(y).eqNullSafe(F.col("_class"))).drop("_class")
    else:
        placed = placed.withColumn("_n", sizes.select("_n").scalar())
    split = F.when(F.col("_i") <= F.ceil(F.col("_n") * F.lit(share)), "validation").otherwise("train")
    return placed.withColumn("split", split).drop("_digest", "_i", "_n")


def empty_classes(split: DataFrame, y: str = "y") -> DataFrame:
    """Classes that have no row in one of the parts: a model cannot be judged on them."""
    held = F.count_if(F.col("split") == "validation")
    return split.groupBy(y).agg(held.alias("validation"), (F.count(F.lit(1)) - held).alias("train")).where(
        "validation = 0 or train = 0"
    )


def time_folds(df: DataFrame, folds: Sequence[tuple[int, int]] = ((45, 50), (50, 55), (55, 60)), ts: str = "ts") -> DataFrame:
    """Expanding folds: train on days 1..a, test on days a+1..b, counted from the first day.

    A row is repeated once per fold it takes part in.
    """
    first_day = df.select(F.to_date(F.min(ts))).scalar()
    dated = df.withColumn("_day", F.datediff(F.to_date(ts), first_day) + 1)
    day = F.col("_day")
    options = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("fold"),
                F.when(day <= a, "train").when(day <= b, "test").alias("part"),
            )
            for i, (a, b) in enumerate(folds)
        ]
    )
    return (
        dated.withColumn("_f", F.explode(F.filter(options, lambda o: o["part"].isNotNull())))
        .withColumns({"fold": F.col("_f.fold"), "part": F.col("_f.part")})
        .drop("_f", "_day")
    )


def fold_metrics(folds: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    yes, one = F.col(p) >= threshold, F.col(y) == 1
    tp, fp, fn = [F.sum(c.cast("bigint")) for c in (one & yes, ~one & yes, one & ~yes)]
    return folds.groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y)).cast("bigint").alias("positives"),
        _ratio(2 * tp, (2 * tp + fp + fn).cast("double")).alias("f1"),
    )


def match_forecasts(forecasts: DataFrame, happened: DataFrame, within_seconds: int = 3600, by: Sequence[str] = ("device_id",)) -> DataFrame:
    """Each forecast with what happened nearest to its time; forecasts without any inside the limit are left out."""
    return asof_nearest(forecasts, happened, within_seconds, by).where("match_ts is not null").drop("match_ts")


def forecast_monitor(scored: DataFrame, threshold: float = 0.5, ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """Daily confusion counts and scores of forecasts against what happened."""
    yes, one = F.col(p) >= threshold, F.col(y) == 1
    counts = scored.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date")).agg(
        *[
            F.sum(c.cast("bigint")).alias(n)
            for n, c in (("tp", one & yes), ("fp", ~one & yes), ("fn", one & ~yes), ("tn", ~one & ~yes))
        ]
    )
    return counts.select("date", *_scores(F.lit(threshold), *[F.col(c) for c in ("tp", "fp", "fn", "tn")]))
