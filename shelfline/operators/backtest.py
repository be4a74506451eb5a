"""Rolling-origin backtests of all series in one plan.

A series row knows its position and the length of its series, and from those every fold it belongs
to follows by arithmetic.  Rows are therefore repeated only for the folds that read them; there is
no join, and everything after the first shuffle by series stays where it is.

Series are daily (one row per entity and day), so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import metrics as M
from shelfline.operators.forecast import NAIVE, SEASONAL, ModelConfig, predict_column

MAX_SPLITS, MAX_GAP, MAX_HORIZON, LEAST_TRAIN = 20, 30, 90, 7


@dataclass(frozen=True, kw_only=True)
class SplitConfig:
    strategy: str = "expanding"
    n_splits: int = 5
    min_train_size: int = 30
    gap: int = 0
    horizon: int = 14

    def __post_init__(self):
        if self.strategy not in ("expanding", "sliding"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if not 2 <= self.n_splits <= MAX_SPLITS:
            raise ValueError(f"n_splits must lie in 2..{MAX_SPLITS}")
        if not 0 <= self.gap <= MAX_GAP:
            raise ValueError(f"gap must lie in 0..{MAX_GAP}")
        if not 1 <= self.horizon <= MAX_HORIZON:
            raise ValueError(f"horizon must lie in 1..{MAX_HORIZON}")
        if self.horizon <= self.gap:
            raise ValueError("horizon must exceed gap")
        if self.min_train_size < LEAST_TRAIN:
            raise ValueError(f"min_train_size must be at least {LEAST_TRAIN}")

    @property
    def least_rows(self) -> int:
        return self.min_train_size + self.gap + self.horizon


@dataclass(frozen=True)
class Fold:
    """Row positions of one fold; ends are exclusive."""

    train_start: Column
    train_end: Column
    test_start: Column
    test_end: Column


def _fold(cfg: SplitConfig, f: Column) -> Fold:
    first = f * F.col("_step")
    end = first + cfg.min_train_size
    start = F.lit(0) if cfg.strategy == "expanding" else first
    return Fold(start, end, end + cfg.gap, end + cfg.gap + cfg.horizon)


def _plan_columns(cfg: SplitConfig, n: Column) -> tuple[Column, Column]:
    """Number of folds and step between them for a series of ``n`` rows."""
    m, g, h, k = cfg.min_train_size, cfg.gap, cfg.horizon, cfg.n_splits
    room = F.floor((n - m - g) / h)
    folds = F.when(n < m + g + k * h, F.least(F.lit(k), F.greatest(F.lit(1), room))).otherwise(F.lit(k))
    folds = folds.cast("int")
    step = F.when(
        folds > 1, F.greatest(F.lit(1), F.floor((n - m - g - h) / F.greatest(folds - 1, F.lit(1))))
    ).otherwise(F.lit(h))
    return folds, step.cast("int")


def indexed(series: DataFrame, entity: Sequence[str], target: str = "quantity") -> DataFrame:
    """Rows with position ``i`` (0-based) and series length ``n``."""
    w = Window.partitionBy(*entity)
    return series.select(
        *entity,
        "date",
        F.col(target).cast("double").alias("y"),
        (F.row_number().over(w.orderBy("date")) - 1).alias("i"),
        F.count(F.lit(1)).over(w).cast("int").alias("n"),
    )


def too_short(series: DataFrame, cfg: SplitConfig, entity: Sequence[str]) -> DataFrame:
    """Series with fewer rows than one fold needs."""
    return (
        series.groupBy(*entity)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < cfg.least_rows)
        .withColumn("needed", F.lit(cfg.least_rows))
    )


def _folds_around(cfg: SplitConfig, before: int) -> Column:
    """Folds whose rows from ``before`` rows ahead of the training end up to the test end hold row ``i``.

    Training ends at ``min_train_size + fold * step``, so these folds are one run of numbers that
    follows from the position by division: a row costs the same whatever the number of folds.
    """
    i, step = F.col("i"), F.col("_step")
    reach = cfg.min_train_size + cfg.gap + cfg.horizon
    last_complete = F.floor((F.col("n") - reach) / step)
    low = F.greatest(F.lit(0), F.ceil((i - reach + 1) / step))
    high = F.least(F.col("_folds") - 1, last_complete, F.floor((i - cfg.min_train_size + before) / step))
    return _run(low, high)


def _run(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def fold_rows(
    series: DataFrame,
    cfg: SplitConfig,
    entity: Sequence[str],
    folds: Callable[[], Column],
    target: str = "quantity",
) -> DataFrame:
    """Each row once per fold in the array ``folds()``, with the positions of that fold."""
    rows = indexed(series, entity, target).where(F.col("n") >= cfg.least_rows)
    count, step = _plan_columns(cfg, F.col("n"))
    rows = (
        rows.withColumn("_folds", count).withColumn("_step", step).withColumn("fold", F.explode(folds()))
    )
    fold = _fold(cfg, F.col("fold"))
    return rows.withColumns(
        {
            "train_start_idx": fold.train_start,
            "train_end_idx": fold.train_end,
            "test_start_idx": fold.test_start,
            "test_end_idx": fold.test_end,
        }
    ).drop("_folds", "_step")


def fold_membership(series: DataFrame, cfg: SplitConfig, entity: Sequence[str]) -> DataFrame:
    """Label train, gap or test of every row in every fold that spans it."""

    def spanning() -> Column:
        i, step = F.col("i"), F.col("_step")
        reach = cfg.least_rows
        low = F.greatest(F.lit(0), F.ceil((i - reach + 1) / step))
        high = F.least(F.col("_folds") - 1, F.floor((F.col("n") - reach) / step))
        return _run(low, high if cfg.strategy == "expanding" else F.least(high, F.floor(i / step)))

    rows = fold_rows(series, cfg, entity, spanning)
    i = F.col("i")
    role = (
        F.when(i < F.col("train_end_idx"), "train").when(i < F.col("test_start_idx"), "gap").otherwise("test")
    )
    return rows.select(*entity, "fold", "date", i.alias("row_index"), role.alias("role"))


def split_boundaries(series: DataFrame, cfg: SplitConfig, entity: Sequence[str]) -> DataFrame:
    """First and last train and test day of each fold, from the rows at the edges of the fold."""

    def at_edges() -> Column:
        i, step = F.col("i"), F.col("_step")
        last_complete = F.floor((F.col("n") - cfg.least_rows) / step)
        last = F.least(F.col("_folds") - 1, last_complete).cast("int")
        if cfg.strategy == "expanding":
            starts = F.when(i == 0, _run(F.lit(0), last))
        else:
            starts = F.when((i % step == 0) & (i / step <= last), F.array((i / step).cast("int")))
        return F.array_union(_folds_around(cfg, 1), F.coalesce(starts, F.array().cast("array<int>")))

    c = F.col
    i, day = c("i"), c("date")
    edges = fold_rows(series, cfg, entity, at_edges).where(
        i.isin(c("train_start_idx"), c("train_end_idx") - 1, c("test_start_idx"), c("test_end_idx") - 1)
    )
    at = lambda position: F.max(F.when(i == position, day))
    return edges.groupBy(
        *entity, "fold", "train_start_idx", "train_end_idx", "test_start_idx", "test_end_idx"
    ).agg(
        at(c("train_start_idx")).alias("train_start"),
        at(c("train_end_idx") - 1).alias("train_end"),
        at(c("test_start_idx")).alias("test_start"),
        at(c("test_end_idx") - 1).alias("test_end"),
    ).withColumn("train_size", c("train_end_idx") - c("train_start_idx")).withColumn(
        "test_size", c("test_end_idx") - c("test_start_idx")
    )


def leakage_check(boundaries: DataFrame, cfg: SplitConfig, entity: Sequence[str]) -> DataFrame:
    """Per series: training ends before testing starts, the gap is kept, the row sets are disjoint."""
    c = F.col
    in_order = c("train_end") < c("test_start")
    gap_kept = c("test_start_idx") - c("train_end_idx") >= cfg.gap
    apart = c("train_end_idx") <= c("test_start_idx")
    return boundaries.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("folds"),
        F.bool_and(in_order).alias("in_order"),
        F.bool_and(gap_kept).alias("gap_kept"),
        F.bool_and(apart).alias("disjoint"),
        F.bool_and(in_order & gap_kept & apart).alias("passed"),
    )


def model_names(models: Sequence[ModelConfig] | Mapping[str, ModelConfig]) -> dict[str, ModelConfig]:
    """Models by the name that tells them apart: the caller's, else the type, with the config hash where a type occurs twice."""
    if isinstance(models, Mapping):
        return dict(models)
    types = Counter(m.model_type for m in models)
    named = [(m.model_type if types[m.model_type] == 1 else f"{m.model_type}-{m.config_hash()[:8]}", m) for m in models]
    if len(dict(named)) < len(named):
        raise ValueError("two models are equal")
    return dict(named)


def backtest(
    series: DataFrame,
    models: Sequence[ModelConfig] | Mapping[str, ModelConfig],
    cfg: SplitConfig,
    entity: Sequence[str],
    target: str = "quantity",
    baselines: Sequence[str] = (),
) -> DataFrame:
    """Actual and predicted value per series, fold, model and test day; ``model`` is the name of ``model_names``.

    A model sees nothing but the last ``tail`` training rows of its fold.  One that needs more rows than
    the smallest training set has is an error, unless it is among the ``baselines``: those are left out.
    """
    named = model_names(models)
    short = [name for name, m in named.items() if m.tail > cfg.min_train_size]
    if failing := [name for name in short if name not in baselines]:
        raise ValueError(f"{', '.join(failing)} cannot be fitted on min_train_size rows")
    names = [name for name in named if name not in short]
    if not names:
        raise ValueError("no model can be fitted on min_train_size rows")
    usable = [named[name] for name in names]
    tail = max(m.tail for m in usable)
    rows = fold_rows(series, cfg, entity, lambda: _folds_around(cfg, tail), target)
    i = F.col("i")
    train = F.when(i < F.col("train_end_idx"), F.struct("i", "y"))
    test = F.when(i >= F.col("test_start_idx"), F.struct("i", "date", "y"))
    # arrays of at most ``tail`` and ``horizon`` entries
    per_fold = rows.groupBy(*entity, "fold", "test_start_idx").agg(
        F.transform(F.array_sort(F.collect_list(train)), lambda p: p["y"]).alias("_tail"),
        F.array_sort(F.collect_list(test)).alias("_test"),
    )
    tests = per_fold.withColumn("_t", F.explode("_test")).withColumn(
        "step", (F.col("_t.i") - F.col("test_start_idx")).cast("int")
    )
    columns = {
        f"_p_{i}": predict_column(m, F.slice("_tail", F.lit(-m.tail), F.lit(m.tail)), F.col("step"))
        for i, m in enumerate(usable)
    }
    forecasts = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(f"_p_{i}").alias("value")) for i, name in enumerate(names)]
    )
    return tests.withColumns(columns).withColumn("_p", F.explode(forecasts)).select(
        *entity,
        "fold",
        F.col("_p.model").alias("model"),
        "step",
        F.col("_t.date").alias("date"),
        F.col("_t.y").alias("actual"),
        F.col("_p.value").alias("prediction"),
    )


def fold_metrics(predictions: DataFrame, entity: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*entity, "model", "fold").agg(
        *M.fold_metrics(F.col("actual"), F.col("prediction"))
    )


def aggregate_folds(per_fold: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Long format: mean over folds and stability of each measure, with a warning above 50 percent."""
    wide = per_fold.groupBy(*entity, "model").agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.struct(M.fold_mean(F.col(m)).alias("value"), M.stability(F.col(m)).alias("stability")).alias(m)
          for m in M.METRICS],
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("at")) for m in M.METRICS])
    s = F.col("stability")
    return (
        wide.select(*entity, "model", "folds", F.explode(pairs).alias("_p"))
        .select(
            *entity,
            "model",
            "folds",
            F.col("_p.metric").alias("metric"),
            F.col("_p.at.value").alias("value"),
            F.col("_p.at.stability").alias("stability"),
        )
        .withColumn("unstable", ~F.isnan(s) & (s > 50))
    )


def compare_baselines(
    aggregated: DataFrame,
    main: str,
    entity: Sequence[str],
    baselines: Sequence[str] = (NAIVE.model_type, SEASONAL.model_type),
) -> DataFrame:
    """Main model next to the baselines with the improvement in percent.

    Signed measures are compared by size.  No percentage for a baseline of 0 or NaN; a baseline that was
    left out has NULLs.
    """
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("value")))
    wide = aggregated.groupBy(*entity, "metric").agg(
        pick(main).alias("main"), *[pick(b).alias(b) for b in baselines]
    )
    signed = F.col("metric").isin(list(M.SIGNED))

    def size(name: str) -> Column:
        return F.when(signed, F.abs(F.col(name))).otherwise(F.col(name))

    for b in baselines:
        base = F.when(~F.isnan(F.col(b)), size(b))
        wide = wide.withColumn(f"vs_{b}_pct", F.try_divide(base - size("main"), base) * 100)
    return wide.where(F.col("main").isNotNull())


def compare_results(a: DataFrame, b: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Two aggregated results (entity, metric, value) side by side; lower is better and ties go to a.

    ``verdict`` repeats the better model by MAE on every row of the entity, ``tie`` when equal.
    """
    keys = [*entity, "metric"]
    left = a.select(*keys, F.col("value").alias("model_a"))
    right = b.select(*keys, F.col("value").alias("model_b"))
    both = left.join(right, keys, "full")
    va, vb = F.col("model_a"), F.col("model_b")
    known = va.isNotNull() & vb.isNotNull()
    diff = F.when(known, vb - va)
    is_mae = F.col("metric") == "mae"
    mae_a = F.max(F.when(is_mae, va)).over(Window.partitionBy(*entity))
    mae_b = F.max(F.when(is_mae, vb)).over(Window.partitionBy(*entity))
    return both.select(
        *keys,
        va,
        vb,
        diff.alias("difference"),
        F.when(F.abs(va) > 1e-10, F.try_divide(diff, F.abs(va)) * 100).alias("percent_change"),
        F.when(known, F.when(va <= vb, "a").otherwise("b")).alias("better_model"),
        F.when(mae_a < mae_b, "a").when(mae_b < mae_a, "b").when(mae_a == mae_b, "tie").alias("verdict"),
    )
