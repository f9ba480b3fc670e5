"""Window and time-series operators.

Each takes the track keys and an order column, so that windows of one track share one exchange whatever is computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.vectors import distance

Keys = Sequence[str]
_TINY = 1e-9


def whole(keys: Keys):
    return Window.partitionBy(*keys)


def ordered(keys: Keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def rolling_median(x: Column, keys: Keys, order: str, rows: int = 3) -> Column:
    """Centred median over `rows` rows, cut at the ends, NULLs passed over."""
    half = rows // 2
    return F.percentile(x, 0.5).over(ordered(keys, order).rowsBetween(-half, half))


def gradient(x: Column, keys: Keys, order: str) -> Column:
    """Central difference for each row, one-sided at the ends; NULL in a track of one row."""
    w = ordered(keys, order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, after - x).when(last, x - before).otherwise((after - before) / 2)


def filled(x: Column, keys: Keys) -> Column:
    """NULLs replaced by the track's median."""
    return F.coalesce(x, F.median(x).over(whole(keys)))


def robust_z(rows: DataFrame, x: str, keys: Keys, out: str, scaled: bool = True, positive: bool = False) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-9) for each track; without the factor if not scaled; the positive part if asked."""
    return robust_zs(rows, {x: out}, keys, scaled, positive)


def robust_zs(rows: DataFrame, named: Mapping[str, str], keys: Keys, scaled: bool = True, positive: bool = False) -> DataFrame:
    """robust_z of several columns (x -> out) by two windows in all."""
    w = whole(keys)
    rows = rows.withColumns({f"__m_{x}": F.median(x).over(w) for x in named})
    rows = rows.withColumns({f"__d_{x}": F.median(F.abs(F.col(x) - F.col(f"__m_{x}"))).over(w) for x in named})
    z = {out: (F.col(x) - F.col(f"__m_{x}")) / (F.col(f"__d_{x}") * (1.4826 if scaled else 1.0) + _TINY) for x, out in named.items()}
    return rows.withColumns({out: F.greatest(v, F.lit(0.0)) if positive else v for out, v in z.items()}).drop(*[f"__{k}_{x}" for x in named for k in "md"])


def state_scaled(rows: DataFrame, names: Sequence[str], keys: Keys) -> DataFrame:
    """Each named column: NULL to the median, then (x - median) / (MAD + 1e-9); all-NULL tracks become 0."""
    w = whole(keys)
    rows = rows.withColumns({f"__m_{n}": F.median(n).over(w) for n in names})
    rows = rows.withColumns({n: F.coalesce(n, f"__m_{n}") for n in names})
    rows = rows.withColumns({f"__d_{n}": F.median(F.abs(F.col(n) - F.col(f"__m_{n}"))).over(w) for n in names})
    rows = rows.withColumns({n: F.coalesce((F.col(n) - F.col(f"__m_{n}")) / (F.col(f"__d_{n}") + _TINY), F.lit(0.0)) for n in names})
    return rows.drop(*[f"__{k}_{n}" for n in names for k in "md"])


def minmax(x: Column, keys: Keys) -> Column:
    w = whole(keys)
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + _TINY)


def boxcar(x: Column, keys: Keys, order: str, rows: int) -> Column:
    """Moving sum over a constant divisor, the outside counting 0; as wide to the left as to the right, one more left if even."""
    w = ordered(keys, order).rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    return F.sum(x).over(w) / rows


def runs(rows: DataFrame, flag: Column, keys: Keys, order: str, gap: int = 1, least: int = 1) -> DataFrame:
    """Runs of flagged rows: keys, run (from 1), first, last, n. Rows up to `gap` apart in `order` belong together; shorter runs than `least` go."""
    on = rows.where(flag).select(*keys, F.col(order).alias("__o"))
    new = (F.col("__o") - F.lag("__o").over(ordered(keys, "__o")) > gap).cast("int")
    on = on.withColumn("__new", F.coalesce(new, F.lit(1)))
    on = on.withColumn("run", F.sum("__new").over(ordered(keys, "__o").rowsBetween(Window.unboundedPreceding, 0)))
    found = on.groupBy(*keys, "run").agg(F.min("__o").alias("first"), F.max("__o").alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def in_sustained_run(rows: DataFrame, flag: Column, keys: Keys, order: str, out: str, gap: int = 2, least: int = 3) -> DataFrame:
    """Adds `out`: whether the row is flagged and in a run of `least` flagged rows with steps up to `gap`."""
    w = ordered(keys, order)
    flagged = F.coalesce(flag, F.lit(False))
    rows = rows.withColumn("__f", flagged)
    seen = F.last(F.when(F.col("__f"), F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", (F.col("__f") & (seen.isNull() | (F.col(order) - seen > gap))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.when(F.col("__f"), 1)).over(Window.partitionBy(*keys, "__run"))
    return rows.withColumn(out, F.col("__f") & (size >= least)).drop("__f", "__new", "__run")


def row_runs(rows: DataFrame, flag: Column, keys: Keys, order: str, least: int = 3) -> DataFrame:
    """Runs of flagged rows that follow each other by position: keys, first, last, n."""
    w = ordered(keys, order)
    numbered = rows.select(*keys, F.col(order).alias("__o"), F.coalesce(flag, F.lit(False)).alias("__f"), F.row_number().over(w).alias("__n"))
    on = numbered.where("__f").withColumn("__g", F.col("__n") - F.row_number().over(ordered(keys, "__o")))
    return on.groupBy(*keys, "__g").agg(F.min("__o").alias("first"), F.max("__o").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__g")


def first_sustained(rows: DataFrame, flag: Column, keys: Keys, order: str, length: int) -> DataFrame:
    """keys, start: the order value at which `flag` first holds for `length` rows in turn; tracks without one are absent."""
    w = ordered(keys, order)
    held = F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w.rowsBetween(0, length - 1))
    left = F.count("*").over(w.rowsBetween(0, length - 1))
    return rows.select(*keys, F.col(order), ((held == 1) & (left == length)).alias("__ok")).where("__ok").groupBy(*keys).agg(F.min(order).alias("start"))


def is_peak(x: Column, keys: Keys, order: str) -> Column:
    """At least as great as both neighbours, which both must exist."""
    w = ordered(keys, order)
    return F.coalesce((x >= F.lag(x).over(w)) & (x >= F.lead(x).over(w)), F.lit(False))


def burnt_in(rows: DataFrame, x: str | Mapping[str, str], started: Column, keys: Keys, order: str, skip: int, out: str | None = None) -> DataFrame:
    """Adds `out`: x, but NULL outside `started` rows and in the first `skip` rows counted from the track's first started row. x may be several columns (x -> out)."""
    rows = rows.withColumn("__n", F.row_number().over(ordered(keys, order)))
    rows = rows.withColumn("__first", F.min(F.when(started, F.col("__n"))).over(whole(keys)))
    named = x if isinstance(x, Mapping) else {x: out}
    return rows.withColumns({o: F.when(started & (F.col("__n") >= F.col("__first") + skip), F.col(c)) for c, o in named.items()}).drop("__n", "__first")


def percentile_rank(x: Column, keys: Keys) -> Column:
    """Share of the track's values that are not greater, times 100; NULL stays NULL."""
    w = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    return F.when(x.isNotNull(), F.cume_dist().over(w) * 100)


def unit_rank(x: Column, keys: Keys, tie: str, flip: bool = False) -> Column:
    """Rank from 0 to 1 within the track, NULLs last, ties by `tie`; 1 minus it if flipped."""
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last(), F.col(tie))
    rank = (F.row_number().over(w) - 1) / F.greatest(F.count("*").over(whole(keys)) - 1, F.lit(1))
    return 1 - rank if flip else rank


def vector_step(vector: Column, keys: Keys, order: str) -> Column:
    """Length of the step from the row before; the first row takes the second's."""
    w = ordered(keys, order)
    own, after = distance(vector, F.lag(vector).over(w)), distance(F.lead(vector).over(w), vector)
    return F.coalesce(own, after)


def seams(rows: DataFrame, raw_id: str, keys: Keys, order: str) -> DataFrame:
    """Rows where the raw id changes from the row before: keys, order, before, after, gap."""
    w = ordered(keys, order)
    found = rows.select(*keys, order, F.lag(raw_id).over(w).alias("before"), F.col(raw_id).alias("after"), (F.col(order) - F.lag(order).over(w)).alias("gap"))
    return found.where("before <> after")


def absences(rows: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Gaps in a track's frames between its first and last: keys, first, last, n. Found from steps between rows, without listing frames."""
    w = ordered(keys, order)
    step = rows.select(*keys, F.col(order).alias("__o"), F.lead(order).over(w).alias("__next")).where("__next - __o > 1")
    return step.select(*keys, (F.col("__o") + 1).alias("first"), (F.col("__next") - 1).alias("last"), (F.col("__next") - F.col("__o") - 1).alias("n"))


def difference(x: Column, keys: Keys, order: str) -> Column:
    """x minus the row before's, which counts 0 for the first row."""
    return x - F.coalesce(F.lag(x).over(ordered(keys, order)), F.lit(0.0))


def split_half_drift(rows: DataFrame, keys: Keys, order: str, vector: str, width: int = 3, least: int = 5) -> DataFrame:
    """keys, n, drift: how far the positional medians of a track's first and second half lie apart, as the root mean square over points of `width` numbers.

    Halves are cut by row, the middle row of an odd count to the second. NULL where a half would have fewer than `least` rows; NULL vectors take no part.
    """
    own = rows.where(F.col(vector).isNotNull()).select(*keys, order, vector)
    own = own.withColumn("__n", F.count("*").over(whole(keys))).withColumn("__first", F.row_number().over(ordered(keys, order)) <= F.floor(F.col("__n") / 2))
    parts = own.select(*keys, "__n", "__first", F.posexplode(vector).alias("__pos", "__x"))
    halves = [F.median(F.when(test, F.col("__x"))) for test in (F.col("__first"), ~F.col("__first"))]
    apart = parts.groupBy(*keys, "__n", "__pos").agg((halves[0] - halves[1]).alias("__d"))
    found = apart.groupBy(*keys, F.col("__n").alias("n")).agg(F.sqrt(F.sum(F.col("__d") * F.col("__d")) * width / F.count("*")).alias("drift"))
    return found.withColumn("drift", F.when(F.floor(F.col("n") / 2) >= least, F.col("drift")))
