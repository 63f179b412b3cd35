"""Direct multi-horizon linear forecaster (one ridge model per horizon and
series), fitted with distributed normal equations.

Fit plan: every sample is sent once with its label vector; every Arrow batch adds
its rows into Gram matrices ``XᵀX`` and ``XᵀY``, one per group and set of known
labels (``mapInPandas``, a map-side combine: no sample crosses the network). The
partial sums are merged twice, first by group and salt, then by group, in tasks that
hold one running sum per group, and solved per horizon from the sets that hold it.
No group of samples, and no group of partial sums, is ever collected in one task.

Score plan: see ``score_sliding`` (all windows of many series) and
``score_linear`` (given windows).
"""

from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators._common import merged
from tidemark.session import ship_package


def _key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


#: Sums that a task keeps before it passes them on.
MAX_HELD_GROUPS = 64


#: Tasks that the partial sums of one group are spread over in the first merge.
SALTS = 64


def train_samples(samples: DataFrame, keys: Iterable[str] = (), split: str | None = "train") -> DataFrame:
    """``(keys…, xf ARRAY<DOUBLE>, y ARRAY<DOUBLE>)``, one row per sample with any
    label. ``split``: 'train' (is_train and not is_val when present), 'all' or None."""
    keys = list(keys)
    s = samples
    if split == "train":
        s = s.where("is_train")
        if "is_val" in s.columns:
            s = s.where(~F.col("is_val"))
    return s.where(F.exists("y", lambda v: v.isNotNull())).select(*keys, F.flatten("x").alias("xf"), "y")


def _merged(frames, names: list[str]):
    """Rows with equal ``names`` added up, at most ``MAX_HELD_GROUPS`` held; the sums
    are arrays, the rest of a row comes from its first."""
    held: dict = {}
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            key = tuple(getattr(row, k) for k in names)
            now = (np.asarray(row.gram), np.asarray(row.xty), int(row.n))
            held[key] = tuple(a + b for a, b in zip(held[key], now)) if key in held else now
            if len(held) > MAX_HELD_GROUPS:
                yield held
                held = {}
    if held:
        yield held


def fit_linear(samples: DataFrame, keys: Iterable[str] = (), reg: float = 1e-3,
               split: str | None = "train") -> DataFrame:
    """Models ``(keys…, days_ahead, weights ARRAY<DOUBLE>, intercept, n, dim)``.

    Minimises ``mean((y − x·w − b)²) + reg·|w|²`` exactly (the intercept is
    not penalised). Windows are expected already scaled. A horizon without any
    label has no model.
    """
    keys = list(keys)
    ship_package(samples.sparkSession)
    flat = train_samples(samples, keys, split)
    kf = _key_fields(flat, keys)
    group = keys + ["known"]
    gram_schema = T.StructType(kf + [
        T.StructField("known", T.LongType()),  # bit h: label of horizon h + 1 is there
        T.StructField("horizons", T.IntegerType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("gram", T.ArrayType(T.DoubleType())),
        T.StructField("xty", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()),
    ])
    names = group + ["horizons", "salt"]

    def rows_of(held: dict) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(names, k)) | dict(gram=g, xty=b, n=n) for k, (g, b, n) in held.items()])

    def partial(batches):
        """One sum per group, set of known labels and task; a task that meets many
        groups (series lie together after the window stage) passes finished ones on."""
        from pyspark import TaskContext
        salt, held = TaskContext.get().partitionId() % SALTS, {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["xf"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            y = np.vstack([np.asarray(v, dtype=float) for v in pdf["y"]])  # NULL: NaN
            there = ~np.isnan(y)
            tag = pd.DataFrame({k: pdf[k].to_numpy() for k in keys} | {"known": there @ (1 << np.arange(y.shape[1]))})
            for key, at in tag.groupby(group, sort=False, dropna=False).indices.items():
                key = (key if isinstance(key, tuple) else (key,)) + (y.shape[1], salt)
                xa, ya = x[at], np.where(there[at], y[at], 0.0)
                now = ((xa.T @ xa).ravel(), (xa.T @ ya).ravel(), len(at))
                held[key] = tuple(a + b for a, b in zip(held[key], now)) if key in held else now
            if len(held) > MAX_HELD_GROUPS:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    def merge(batches):
        for held in _merged(batches, names):
            yield rows_of(held)

    out_schema = T.StructType(kf + [
        T.StructField("days_ahead", T.IntegerType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("dim", T.IntegerType()),
    ])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most ``SALTS`` sums (and what a merge passed on early) per set of known labels."""
        horizons, rows = int(pdf["horizons"].iloc[0]), []
        for h in range(horizons):
            some = pdf[(pdf["known"].to_numpy() >> h & 1) == 1]
            if some.empty:
                continue
            d1 = len(some["xty"].iloc[0]) // horizons
            gram = np.sum([np.asarray(g) for g in some["gram"]], axis=0).reshape(d1, d1)
            xty = np.sum([np.asarray(b) for b in some["xty"]], axis=0).reshape(d1, horizons)[:, h]
            n = int(some["n"].sum())
            pen = np.eye(d1) * reg * n
            pen[-1, -1] = 0.0
            w = np.linalg.lstsq(gram + pen, xty, rcond=None)[0]
            rows.append({k: pdf[k].iloc[0] for k in keys} | dict(days_ahead=h + 1, weights=w[:-1].tolist(), intercept=float(w[-1]),
                                                                 n=n, dim=d1 - 1))
        return pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    parts = flat.mapInPandas(partial, gram_schema)
    merged = parts.repartition(*keys, "known", "salt").mapInPandas(merge, gram_schema)
    if keys:
        return merged.groupBy(*keys).applyInPandas(solve, out_schema)
    return merged.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(solve, out_schema)


def pack_models(models: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: ``models ARRAY<STRUCT<days_ahead, weights, intercept>>``
    sorted by horizon (numeric, never by name)."""
    keys = list(keys)
    return models.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("days_ahead", "weights", "intercept"))).alias("models"))


def dot(xf, w):
    """Σ xf[i]·w[i] as a higher-order array expression (any length; not
    code-generated, used when the window shape is unknown)."""
    return F.aggregate(F.zip_with(xf, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def score_sliding(frame: DataFrame, models: DataFrame, cols: Sequence[str], lag: int,
                  keys: Iterable[str]) -> DataFrame:
    """Long predictions ``(keys…, ssd, days_ahead, prediction)`` for every complete
    window of ``lag`` frame rows, without building the windows: a series' rows meet
    its models once, each lag step's product ``X·W_stepᵀ`` covers all rows, and the
    products are added up shifted by their step. A row travels once, not ``lag``
    times. A group is one series, bounded by its calendar."""
    keys = list(keys)
    ship_package(frame.sparkSession)
    out_schema = T.StructType(_key_fields(frame, keys) + [
        T.StructField("ssd", T.DateType()), T.StructField("days_ahead", T.IntegerType()), T.StructField("prediction", T.DoubleType())])
    cols = list(cols)

    def per_series(rows: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        n = len(rows) - lag + 1
        if n < 1 or m.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out_schema.fields})
        rows, m = rows.sort_values("ssd"), m.sort_values("days_ahead")
        x, w = rows[cols].to_numpy(dtype=float), np.vstack(m["weights"].to_numpy()).reshape(len(m), lag, len(cols))
        p = np.tile(m["intercept"].to_numpy(dtype=float), (n, 1))
        for step in range(lag):
            p += x[step:step + n] @ w[:, step].T
        out = {k: np.repeat(rows[k].to_numpy()[:n], len(m)) for k in keys}
        out["ssd"] = np.repeat(rows["ssd"].to_numpy()[lag - 1:], len(m))
        out["days_ahead"] = np.tile(m["days_ahead"].to_numpy(dtype=np.int32), n)
        out["prediction"] = p.ravel()
        return pd.DataFrame(out)

    left = frame.select(*keys, "ssd", *[F.col(c).cast("double").alias(c) for c in cols]).groupBy(*keys)
    right = models.select(*keys, "days_ahead", "weights", "intercept").groupBy(*keys)
    return left.cogroup(right).applyInPandas(per_series, out_schema)


def score_linear(windows: DataFrame, models: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Long predictions ``(keys…, ssd, days_ahead, prediction)`` for every
    window and every horizon model of its series: the models are packed into one
    row per series (one row in all without keys), which joins the windows, and the
    product is an array expression in the JVM. Nothing runs while the plan is built
    and no model passes through the driver. For all windows of long series see
    ``score_sliding``, which is faster."""
    keys = list(keys)
    side = pack_models(models, keys)
    left = windows.select(*keys, "ssd", F.flatten("x").alias("_xf"))
    joined = left.join(merged(side, keys), keys) if keys else left.crossJoin(F.broadcast(side))
    preds = F.transform("models", lambda m: F.struct(
        m["days_ahead"].alias("days_ahead"),
        (dot(F.col("_xf"), m["weights"]) + m["intercept"]).alias("prediction")))
    return (joined.select(*keys, "ssd", F.explode(preds).alias("p"))
            .select(*keys, "ssd", "p.days_ahead", "p.prediction"))


def predictions_wide(preds: DataFrame, horizon: int, keys: Iterable[str] = ()) -> DataFrame:
    """Horizontal stack: one column per horizon (``h1 … hH``)."""
    keys = list(keys)
    return (preds.groupBy(*keys, "ssd").pivot("days_ahead", list(range(1, horizon + 1)))
            .agg(F.first("prediction"))
            .select(*keys, "ssd", *[F.col(str(h)).alias(f"h{h}") for h in range(1, horizon + 1)]))

