"""Time series: range scans, windows for batch and stream alike, gap filling, as-of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def range_scan(df: DataFrame, ts: str, low, high, series: str | None = None, series_id=None) -> DataFrame:
    """Rows with low <= ts <= high, of one series if given; the filter reaches the scan."""
    df = df.filter(F.col(ts).between(low, high))
    return df if series is None else df.filter(F.col(series) == series_id)


def _interval(millis: int) -> str:
    return f"{millis} milliseconds" if millis % 1000 else f"{millis // 1000} seconds"


def windowed(df: DataFrame, kind: str, spans: Sequence[int], ts: Column, keys: Sequence[Column], aggregates: Sequence[Column], watermark: str | None = None) -> DataFrame:
    """Aggregates by window and keys, with window_start and window_end.

    kind is tumbling (size), hopping (size, slide) or session (gap); spans are in
    milliseconds. Windows are half-open and begin at multiples of the slide since
    1970. Streams need a watermark on a timestamp column, which `ts` must be.
    """
    if watermark is not None and df.isStreaming:
        name = "__event_time"
        df = df.withColumn(name, ts.cast("timestamp")).withWatermark(name, watermark)
        ts = F.col(name)
    if kind == "session":
        window = F.session_window(ts, _interval(spans[0]))
    elif kind == "hopping":
        size, slide = spans
        if slide > size:
            raise ValueError("a hopping window's slide is at most its size")
        window = F.window(ts, _interval(size), _interval(slide))
    else:
        window = F.window(ts, _interval(spans[0]))
    grouped = df.groupBy(window.alias("__window"), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "__window"]
    return grouped.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *rest)


def fill_gaps(df: DataFrame, size: int, keys: Sequence[str], method: str = "linear") -> DataFrame:
    """Tumbling windows of `size` milliseconds with a row for every window between the first and last of each key.

    Numbers between two known ones are interpolated (`linear`), repeat the last
    (`previous`) or stay null (`null`). Other columns of filled rows are null.
    """
    if method not in ("linear", "previous", "null"):
        raise ValueError(f"no way to fill gaps is called {method}")
    values = [c for c in df.columns if c not in ("window_start", "window_end", *keys)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    step = F.expr(f"INTERVAL {_interval(size)}")
    ends = df.groupBy(*keys).agg(F.min("window_start").alias("__lo"), F.max("window_start").alias("__hi"))
    grid = ends.select(*keys, F.explode(F.sequence("__lo", "__hi", step)).alias("window_start"))
    on = F.lit(True)
    left, right = grid.alias("g"), df.alias("d")
    for k in (*keys, "window_start"):
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}"))
    rows = left.join(right, on, "left").select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("g.window_start").alias("window_start"), *[F.col(f"d.{v}").alias(v) for v in values], F.col("d.window_start").isNotNull().alias("__known"))
    back = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(0, Window.unboundedFollowing)
    numeric = [v for v in values if isinstance(kinds[v], T.NumericType)]
    if method != "null":
        seconds = F.unix_micros(F.col("window_start").cast("timestamp"))
        rows = rows.withColumn("__t", seconds)
        out = []
        for v in values:
            if v not in numeric:
                out.append(F.col(v))
                continue
            known = F.col(v).isNotNull()
            v0, t0 = F.last(F.when(known, F.col(v)), True).over(back), F.last(F.when(known, F.col("__t")), True).over(back)
            if method == "previous":
                out.append(F.coalesce(v, v0).alias(v))
                continue
            v1, t1 = F.first(F.when(known, F.col(v)), True).over(ahead), F.first(F.when(known, F.col("__t")), True).over(ahead)
            between = v0.cast("double") + (v1.cast("double") - v0.cast("double")) * ((F.col("__t") - t0) / F.nullif(t1 - t0, F.lit(0)))
            out.append(F.coalesce(F.col(v).cast("double"), between).alias(v))
        rows = rows.select(*keys, "window_start", *out)
    return rows.select("window_start", (F.col("window_start") + step).alias("window_end"), *keys, *values)


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str]) -> DataFrame:
    """left with the columns `take` of right's last row of the same key at or before left_ts; null where none is.

    Both sides are united and swept once in key and time order, so that a key's
    history is never multiplied by its lookups.
    """
    tag = [F.col(c) for c in on]
    lefts = left.select(*tag, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__found"))
    rights = right.select(*tag, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(*take).alias("__found"))
    sweep = Window.partitionBy(*on).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = lefts.unionByName(rights).withColumn("__last", F.last("__found", True).over(sweep)).filter("__side = 1")
    return both.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in take])
