"""Per-machine time-series features and the forward-looking label.

Every feature is a time frame over one machine's rows ordered by time:

* rolling ``<sensor>_<stat>_<h>h``: count, mean, std, min, max over (t - h, t];
* lag ``<sensor>_lag<n>``: the value in the hour n hours back, (t - (n+1)h, t - nh]
  (NULL when that hour has no row; on an hourly series, the row at t - n hours);
  ``<sensor>_diff1`` = value - lag1;
* history ``hours_since_<event>``: hours since the latest row at or before t with
  that event, and ``cum_<col>``: running totals;
* label ``label_<h>h``: 1.0 when a failure occurs in (t, t + h], current row excluded.

Splitting hot machines. A machine's history can be long (or dense), so windows
are not evaluated per machine but per (machine, time bucket) of
``bucket_hours`` (one week by default). Each row is also copied, as a halo
row, into the next buckets whose start lies within the longest look-back after
it, and into the previous buckets whose end lies within the label horizon before it
(several buckets, when a window is longer than one). Bounded frames then see every row they need
inside one bucket. Running features add a per-bucket prefix: a small aggregate
of (machine, bucket) summaries, scanned over buckets (a machine has one summary
row per week of history), joined back by (machine, bucket). A task therefore
holds at most one bucket of one machine plus its halos, however long or hot the
machine is: on the gated master (one row per machine and hour) that is at most
168 + 49 rows. The halo costs about (25 + 24) / 168 = 29 % more shuffled rows at
the defaults. ``bucket_hours=None`` evaluates per machine instead (one partition
per machine, fine when histories are short).

All frames of one mode share one window partitioning and order, so Spark computes
them with one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend import contracts as C
from sparkmend.functions.columns import ntz_epoch_micros
from sparkmend.operators.joins import left_join

DEFAULT_WINDOWS_HOURS = (3, 24)
DEFAULT_LAGS = (1, 3, 24)
DEFAULT_STATS = ("count", "mean", "std", "min", "max")
DEFAULT_BUCKET_HOURS = 168
HOUR_US = 3_600_000_000
ORDER_COL = "_t_us"   # epoch microseconds of ``datetime`` (wall clock, zone-free)
BUCKET_COL = "_bucket"
CORE_COL = "_core"    # False on halo copies
KEY = "machineID"
PER_MACHINE = (KEY,)
PER_BUCKET = (KEY, BUCKET_COL)


def with_order_column(df: DataFrame, order: str = "datetime") -> DataFrame:
    return df.withColumn(ORDER_COL, ntz_epoch_micros(order))


def _spec(parts=PER_MACHINE) -> Window:
    return Window.partitionBy(*parts).orderBy(ORDER_COL)


def trailing(hours: int, parts=PER_MACHINE) -> Window:
    """RANGE frame (t - hours, t]."""
    return _spec(parts).rangeBetween(-(hours * HOUR_US - 1), 0)


def hour_back(n: int, parts=PER_MACHINE) -> Window:
    """RANGE frame (t - (n + 1) hours, t - n hours]."""
    return _spec(parts).rangeBetween(-((n + 1) * HOUR_US - 1), -n * HOUR_US)


def following(hours: int, parts=PER_MACHINE) -> Window:
    """RANGE frame (t, t + hours]."""
    return _spec(parts).rangeBetween(1, hours * HOUR_US)


def running(parts=PER_MACHINE) -> Window:
    return _spec(parts).rowsBetween(Window.unboundedPreceding, Window.currentRow)


_STATS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
          "sum": F.sum}


def rolling_exprs(sensors: list[str], windows_hours=DEFAULT_WINDOWS_HOURS,
                  stats=DEFAULT_STATS, parts=PER_MACHINE) -> list[Column]:
    """``<sensor>_<stat>_<h>h`` over the trailing ``h`` hours, for every sensor, stat and h."""
    out = []
    for h in windows_hours:
        w = trailing(h, parts)
        for s in sensors:
            for st in stats:
                e = _STATS[st](F.col(s)).over(w)
                if st == "count":
                    e = e.cast("long")
                out.append(e.alias(f"{s}_{st}_{h}h"))
    return out


def lag_exprs(sensors: list[str], lags=DEFAULT_LAGS, parts=PER_MACHINE) -> list[Column]:
    """``<sensor>_lag<n>`` (the hour n hours back) and ``<sensor>_diff1``."""
    out = []
    for s in sensors:
        for n in lags:
            out.append(F.last(F.col(s)).over(hour_back(n, parts)).alias(f"{s}_lag{n}"))
        out.append((F.col(s) - F.last(F.col(s)).over(hour_back(1, parts))).alias(f"{s}_diff1"))
    return out


def label_expr(target: str = C.TARGET_COLUMN, horizon_hours: int = 24,
               name: str | None = None, parts=PER_MACHINE) -> Column:
    """1.0 when ``target`` is positive on some row in (t, t + horizon], else 0.0."""
    e = F.max(F.when(F.col(target) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).over(
        following(horizon_hours, parts))
    return F.coalesce(e, F.lit(0.0)).alias(name or f"label_{horizon_hours}h")


def hours_since_exprs(event_cols: list[str], cumulative: list[str] | None = None,
                      split: bool = False, gated: bool | None = None,
                      prefixed: bool | None = None) -> list[Column]:
    """``hours_since_<col>`` and ``cum_<col>``.

    ``gated``: only core rows count (halo rows are context for bounded frames);
    ``prefixed``: add the state before the first row (columns ``_pl_<col>``, the
    latest event time, and ``_ps_<col>``, the running total). ``split`` (per
    bucket) implies both.
    """
    parts = PER_BUCKET if split else PER_MACHINE
    gated = split if gated is None else gated
    prefixed = split if prefixed is None else prefixed
    w = running(parts)
    core = F.col(CORE_COL) if gated else F.lit(True)
    out = []
    for c in event_cols:
        last_us = F.last(F.when(core & (F.col(c) > 0), F.col(ORDER_COL)), ignorenulls=True).over(w)
        if prefixed:
            last_us = F.coalesce(last_us, F.col(f"_pl_{c}"))
        out.append(((F.col(ORDER_COL) - last_us) / F.lit(float(HOUR_US))).alias(f"hours_since_{c}"))
    for c in cumulative or []:
        total = F.sum(F.when(core, F.col(c))).over(w)
        if prefixed:
            total = total + F.coalesce(F.col(f"_ps_{c}"), F.lit(0))
        out.append(total.alias(f"cum_{c}"))
    return out


def running_summary(df: DataFrame, last_cols: list[str], sum_cols: list[str],
                    keys: tuple[str, ...] = PER_MACHINE) -> DataFrame:
    """Per key: latest event time (epoch micros) per column and totals (map-side combined)."""
    t = ntz_epoch_micros("datetime")
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(c) > 0, t)).alias(f"_bl_{c}") for c in last_cols],
        *[F.sum(c).alias(f"_bs_{c}") for c in sum_cols])


def advance_state(prev: DataFrame | None, summary: DataFrame, last_cols: list[str],
                  sum_cols: list[str]) -> DataFrame:
    """Machine state after ``summary``: latest event times and running totals so far."""
    s = summary.select(KEY, *[F.col(f"_bl_{c}").alias(f"_pl_{c}") for c in last_cols],
                       *[F.col(f"_bs_{c}").alias(f"_ps_{c}") for c in sum_cols])
    if prev is None:
        return s
    j = prev.alias("p").join(s.alias("s"), KEY, "full")
    return j.select(KEY,
                    *[F.greatest(F.col(f"p._pl_{c}"), F.col(f"s._pl_{c}")).alias(f"_pl_{c}")
                      for c in last_cols],
                    *[(F.coalesce(F.col(f"p._ps_{c}"), F.lit(0)) + F.coalesce(F.col(f"s._ps_{c}"), F.lit(0)))
                      .alias(f"_ps_{c}") for c in sum_cols])


def _bucketed(base: DataFrame, bucket_hours: int, back_hours: int, ahead_hours: int, core: str | None = None) -> DataFrame:
    """Rows tagged with their bucket, plus halo copies for the neighbouring buckets (rows that are not ``core`` are context everywhere)."""
    bh = bucket_hours * HOUR_US
    t = F.col(ORDER_COL)
    b = F.floor(t / F.lit(bh))
    own = F.col(core) if core else F.lit(True)
    def target(shift: int, keep: Column) -> Column:
        return F.struct((b + shift).alias("b"), (F.lit(shift == 0) & own).alias("core"), keep.alias("keep"))

    # as many neighbouring buckets as the longest look-back and the label horizon reach
    targets = F.array(
        target(0, F.lit(True)),
        *[target(k, t >= (b + k) * F.lit(bh) - F.lit(back_hours * HOUR_US)) for k in range(1, -(-back_hours // bucket_hours) + 1)],
        *[target(-k, t < (b - k + 1) * F.lit(bh) + F.lit(ahead_hours * HOUR_US)) for k in range(1, -(-ahead_hours // bucket_hours) + 1)])
    exploded = base.select("*", F.explode(targets).alias("_tgt")).where(F.col("_tgt.keep"))
    return (exploded.withColumn(BUCKET_COL, F.col("_tgt.b")).withColumn(CORE_COL, F.col("_tgt.core"))
            .drop("_tgt"))


def _bucket_prefix(base: DataFrame, bucket_hours: int, last_cols: list[str],
                   sum_cols: list[str]) -> DataFrame:
    """Per (machine, bucket): latest event time and totals of all earlier buckets."""
    bh = bucket_hours * HOUR_US
    summ = base.groupBy(F.col(KEY), F.floor(F.col(ORDER_COL) / F.lit(bh)).alias(BUCKET_COL)).agg(
        *[F.max(F.when(F.col(c) > 0, F.col(ORDER_COL))).alias(f"_bl_{c}") for c in last_cols],
        *[F.sum(c).alias(f"_bs_{c}") for c in sum_cols])
    # one row per machine and bucket: a machine has one row per week of history here
    wb = Window.partitionBy(KEY).orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
    return summ.select(
        KEY, BUCKET_COL,
        *[F.max(f"_bl_{c}").over(wb).alias(f"_pl_{c}") for c in last_cols],
        *[F.coalesce(F.sum(f"_bs_{c}").over(wb), F.lit(0)).alias(f"_ps_{c}") for c in sum_cols])


def _with_state(prefix: DataFrame, machine_state: DataFrame, last_cols: list[str], sum_cols: list[str]) -> DataFrame:
    """Bucket prefixes continued from the state of each machine before its first core row."""
    state = machine_state.select(KEY, *[F.col(f"_pl_{c}").alias(f"_ml_{c}") for c in last_cols],
                                 *[F.col(f"_ps_{c}").alias(f"_ms_{c}") for c in sum_cols])
    return left_join(prefix, state, [KEY]).select(
        KEY, BUCKET_COL, *[F.greatest(f"_pl_{c}", f"_ml_{c}").alias(f"_pl_{c}") for c in last_cols],
        *[(F.coalesce(f"_ps_{c}", F.lit(0)) + F.coalesce(f"_ms_{c}", F.lit(0))).alias(f"_ps_{c}") for c in sum_cols])


def compute_features(df: DataFrame, keep: list[str], sensors=(), windows_hours=(),
                     stats=DEFAULT_STATS, lags=(), history=(), cumulative=(),
                     label_target: str | None = None, horizon_hours: int = 24,
                     extra_rolling=(), bucket_hours: int | None = DEFAULT_BUCKET_HOURS,
                     machine_state: DataFrame | None = None, core: str | None = None
                     ) -> DataFrame:
    """Evaluate the requested features over ``df`` (per bucket with halos, or per machine).

    ``extra_rolling`` adds ``(column, stat, hours)`` rolling aggregates named
    ``<column>_<hours>h``. Output: ``keep`` columns, then the features in order.

    Two more inputs serve incremental runs: ``core`` names a boolean column; only those rows are returned and counted by
    running features (the others are context for bounded frames), and
    ``machine_state`` (from ``advance_state`` or ``states.state_before``) is the state before the first core row. In buckets
    it goes into the bucket prefixes, so no rows are joined by machine alone.
    """
    base = with_order_column(df)
    split = bucket_hours is not None
    parts = PER_BUCKET if split else PER_MACHINE
    exprs = rolling_exprs(list(sensors), windows_hours, stats, parts)
    exprs += [_STATS[st](F.col(c)).over(trailing(h, parts)).alias(f"{c}_{h}h")
              for c, st, h in extra_rolling]
    exprs += lag_exprs(list(sensors), lags, parts) if lags else []
    if split:
        exprs += hours_since_exprs(list(history), list(cumulative), split=True)
    else:
        if machine_state is not None:
            base = left_join(base, machine_state, [KEY])
        if core:
            base = base.withColumn(CORE_COL, F.col(core))
        exprs += hours_since_exprs(list(history), list(cumulative), gated=core is not None,
                                   prefixed=machine_state is not None)
    if label_target:
        exprs.append(label_expr(label_target, horizon_hours, parts=parts))
    if not split:
        out = base.select(*[F.col(c) for c in keep], *([F.col(CORE_COL)] if core else []), *exprs)
        return out.where(F.col(CORE_COL)).drop(CORE_COL) if core else out
    back = max([1, *windows_hours, *[n + 1 for n in lags], *[h for _, _, h in extra_rolling]])
    rows = _bucketed(base, bucket_hours, back, horizon_hours if label_target else 0, core)
    if history or cumulative:
        prefix = _bucket_prefix(base.where(F.col(core)) if core else base, bucket_hours, list(history), list(cumulative))
        if machine_state is not None:
            prefix = _with_state(prefix, machine_state, list(history), list(cumulative))
        # planned as a shuffled join on (machine, bucket), which the windows reuse; AQE
        # turns it into a broadcast when the measured prefix stage is small
        rows = left_join(rows, prefix, [KEY, BUCKET_COL])
    return (rows.select(*[F.col(c) for c in keep], F.col(CORE_COL), *exprs)
            .where(F.col(CORE_COL)).drop(CORE_COL))


def window_features(df: DataFrame, keep: list[str], bucket_hours: int | None = DEFAULT_BUCKET_HOURS,
                    **features) -> DataFrame:
    """``compute_features`` with keyword arguments (for single feature families)."""
    return compute_features(df, keep=keep, bucket_hours=bucket_hours, **features)


def with_error_count(master: DataFrame) -> DataFrame:
    errors = [c for c in C.ERROR_COUNT_COLUMNS if c in master.columns]
    err_any = sum((F.col(c) for c in errors[1:]), F.col(errors[0])) if errors else F.lit(0.0)
    return master.withColumn("error_count", err_any)


def running_inputs(columns: list[str]) -> tuple[list[str], list[str]]:
    """(columns with an hours-since feature, columns with a running total) of the feature table."""
    history = [c for c in C.MAINTENANCE_COUNT_COLUMNS + C.FAILURE_COUNT_COLUMNS if c in columns]
    return history + ["error_count"], [C.TARGET_COLUMN, "error_count"]


def feature_table(master: DataFrame, sensors: list[str] | None = None,
                  windows_hours=DEFAULT_WINDOWS_HOURS, lags=DEFAULT_LAGS, stats=DEFAULT_STATS,
                  horizon_hours: int = 24, bucket_hours: int | None = DEFAULT_BUCKET_HOURS,
                  machine_state: DataFrame | None = None, core: str | None = None) -> DataFrame:
    """Master columns + rolling + lag + history features + label, in one windowed pass.

    ``machine_state`` and ``core`` serve incremental scoring; see ``compute_features``.
    """
    sensors = C.SENSOR_COLUMNS if sensors is None else sensors
    base = with_error_count(master)
    history, cumulative = running_inputs(master.columns)
    keep = [c for c in base.columns if c != core]
    return compute_features(
        base, keep=keep, sensors=sensors, windows_hours=windows_hours, stats=stats,
        lags=lags, history=history, cumulative=cumulative,
        label_target=C.TARGET_COLUMN, horizon_hours=horizon_hours,
        extra_rolling=[("error_count", "sum", 24)], bucket_hours=bucket_hours,
        machine_state=machine_state, core=core)


def lookback_hours(windows_hours=DEFAULT_WINDOWS_HOURS, lags=DEFAULT_LAGS) -> int:
    """How far back the bounded features of the feature table reach, with an hour to spare."""
    return max(24, *windows_hours, *[n + 1 for n in lags]) + 1


def latest_per_machine(df: DataFrame, key: str = "machineID", order: str = "datetime",
                       cols: list[str] | None = None) -> DataFrame:
    """The latest row of every machine (top-1 by ``order``), one aggregate.

    ``max_by`` has a map-side partial step, so a machine with a third of all rows
    is reduced to one candidate per map task before the shuffle; no per-machine
    sort is needed.
    """
    cols = [c for c in (cols or df.columns) if c not in (key,)]
    packed = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_latest")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"_latest.{c}").alias(c) for c in cols])
