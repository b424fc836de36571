"""Logistic models with their preparation: fitted packages, and cross-validation of many models in one job.

A row's raw numbers z are the vector (zeros where there is none) with a flag for a missing one, the columns (zero where null), a flag for
each column that has nulls, and a one. A model's preparation, which drops columns without values, puts medians for nulls, adds the
flags and scales by mean and population deviation, is linear in z. So tasks never prepare rows: they work on z, and each model has
a matrix that takes sums over z to sums over its prepared features.

All models of a job, whatever their fold, penalty or column set, are fitted together. A pass over the rows gives each model's
gradient and curvature on its own training rows; they are added up over the tasks in two steps, a model by itself, where the
Newton step is taken. The driver sees weights only. Statistics are sums over the folds of a repeat: those of a training part are
all less those of its fold, and medians come from one histogram, so no fold is prepared in a pass of its own.

Defined results: a column without values in the training rows is dropped and has weight zero; a constant one becomes zero; rows
without a label are left out; a training part with one class gives the weights of a constant score."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.functions.ordered import exact_quantiles
from hazardloom.session import shared_path

PASSES = 40
CLOSE = 1e-8  # largest change of a weight in the last step
PARTS = 32  # of the first step of adding up
BLOCK = 1024  # rows of a product that stay in the cache


@dataclass(frozen=True)
class Layout:
    """Columns of z in order: vector, its flag, columns, flags of nullable columns, one."""

    columns: tuple[str, ...]
    nullable: tuple[str, ...]
    vector: str | None = None
    width: int = 0

    @property
    def size(self) -> int:
        return (self.width + 1 if self.vector else 0) + len(self.columns) + len(self.nullable) + 1

    def at(self, column: str) -> int:
        return (self.width + 1 if self.vector else 0) + self.columns.index(column)

    def flag(self, column: str) -> int:
        return (self.width + 1 if self.vector else 0) + len(self.columns) + self.nullable.index(column)

    def names(self) -> list[str]:
        vector = [f"{self.vector}_{i:03d}" for i in range(self.width)] + [f"{self.vector}_missing"] if self.vector else []
        return [*vector, *self.columns, *[f"{c}_missing" for c in self.nullable], "intercept"]

    def numbers(self, b: pa.RecordBatch) -> np.ndarray:
        n, parts = b.num_rows, []
        if self.vector:
            column = b.column(self.vector)
            missing = ~column.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros((n, self.width + 1))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != self.width * int((~missing).sum()):
                raise ValueError(f"a vector's width is not {self.width}")
            out[~missing, : self.width] = flat.reshape(int((~missing).sum()), self.width)
            out[:, self.width] = missing
            parts.append(out)
        plain = [b.column(c).cast(pa.float64()) for c in self.columns]
        parts.append(np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in plain], axis=1) if plain else np.zeros((n, 0)))
        parts.append(np.stack([~plain[self.columns.index(c)].is_valid().to_numpy(zero_copy_only=False) for c in self.nullable], axis=1).astype(np.float64) if self.nullable else np.zeros((n, 0)))
        return np.concatenate([*parts, np.ones((n, 1))], axis=1)


@dataclass(frozen=True)
class Spec:
    """A model: its name, the repeat whose folds it uses, the fold it leaves out (-1: none), C, and the columns it may use (None: all)."""

    name: str
    repeat: int = 0
    out: int = -1
    c: float = 1.0
    columns: tuple[str, ...] | None = None
    with_vector: bool = True


def layout_of(rows: DataFrame, columns: list[str], vector: str | None = None) -> Layout:
    """Columns with nulls and the vector's width, from one aggregate."""
    asked = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    found = rows.agg(*asked, *([F.max(F.size(vector)).alias("width")] if vector else [F.lit(0).alias("width")])).first()
    return Layout(tuple(columns), tuple(c for i, c in enumerate(columns) if found[f"n{i}"]), vector, max(found["width"] or 0, 0))


def stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def evenly(rows: DataFrame, key: str) -> DataFrame:
    """One part a core, by key: a pass of a fit costs far more a byte than the join that made the rows, which adaptive execution
    would leave in as few parts as their bytes fill."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def curvatures(z: np.ndarray, bend: np.ndarray, views: list[tuple[np.ndarray, np.ndarray]], sums: np.ndarray) -> None:
    """Adds to each model's row of sums its z' diag(bend) z, over the columns of z that its view names: others are never used."""
    size = z.shape[1]
    root = np.sqrt(bend)
    for columns, models in views:
        own = np.zeros((len(models), len(columns), len(columns)))
        for start in range(0, len(z), BLOCK):
            part = np.ascontiguousarray(z[start : start + BLOCK, columns])
            for i, m in enumerate(models):
                scaled = part * root[start : start + BLOCK, m : m + 1]
                own[i] += scaled.T @ scaled
        at = (columns[:, None] * size + columns[None, :]).ravel()
        for i, m in enumerate(models):
            sums[m, at] += own[i].ravel()


def added(rows: DataFrame, run, shape: str = "key int, part int, sums binary") -> DataFrame:
    """Per key the sum of the vectors that the tasks give, added up in two steps."""

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, shape)
    return parts.groupBy("key", "part").applyInArrow(total, shape).groupBy("key").applyInArrow(total, shape)


def emitted(sums: np.ndarray) -> pa.RecordBatch:
    """One row per key from a matrix of sums."""
    part = TaskContext.get().partitionId() % PARTS
    n = len(sums)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["key", "part", "sums"])


def folds_of(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column("folds").to_pylist(), np.int64).reshape(b.num_rows, -1)


def moments(rows: DataFrame, layout: Layout, repeats: int, folds: int) -> np.ndarray:
    """[repeat, fold]: sums of z, of its squares, of the rows of class one: 2 * size + 1 numbers."""
    size = layout.size

    def run(batches):
        sums = np.zeros((repeats * folds, 2 * size + 1))
        for b in batches:
            z, y, fold = layout.numbers(b), b.column("truth").to_numpy(zero_copy_only=False).astype(np.float64), folds_of(b)
            whole = np.concatenate([z, z * z, y[:, None]], axis=1)
            for r in range(repeats):
                for f in range(folds):
                    sums[r * folds + f] += whole[fold[:, r] == f].sum(0)
        yield emitted(sums)

    out = np.zeros((repeats * folds, 2 * size + 1))
    for row in added(rows, run).collect():  # one row per repeat and fold
        out[row.key] = np.frombuffer(row.sums, np.float64)
    return out.reshape(repeats, folds, -1)


def medians(rows: DataFrame, layout: Layout, outs: list[int]) -> dict[tuple[int, int, str], float]:
    """(repeat, fold left out, column) to the exact median of the training rows' values, all in one histogram."""
    if not layout.nullable:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in layout.nullable])
    long = rows.select("folds", F.explode(pairs).alias("x")).where("x.value is not null").select("x.feature", "x.value", F.posexplode("folds").alias("repeat", "fold"))
    long = long.withColumn("out", F.explode(F.array(*[F.lit(o) for o in outs]))).where("out <> fold")
    found = exact_quantiles(long.select("repeat", "out", "feature", "value"), ["repeat", "out", "feature"], "value", {"median": 0.5})
    return {(r["repeat"], r.out, r.feature): r["median"] for r in found.collect()}


@dataclass
class Preparation:
    """What a model does to z: u = matrix @ z; `used` says which features it has."""

    mean: np.ndarray
    spread: np.ndarray
    median: dict[str, float]
    counts: np.ndarray  # rows with a value, per column of the layout
    used: np.ndarray
    ones: float
    rows: float
    matrix: np.ndarray = field(repr=False)


def preparation(layout: Layout, sums: np.ndarray, median: dict[str, float], spec: Spec) -> Preparation:
    size, n = layout.size, sums[layout.size - 1]
    total, squares, ones = sums[:size].copy(), sums[size : 2 * size].copy(), sums[-1]
    used = np.ones(size, bool)
    counts = np.full(len(layout.columns), n)
    for c in layout.nullable:
        i, flag = layout.at(c), layout.flag(c)
        missing = total[flag]
        counts[layout.columns.index(c)] = n - missing
        used[i] = missing < n
        total[i] += missing * median.get(c, 0.0)
        squares[i] += missing * median.get(c, 0.0) ** 2
        used[flag] = 0 < missing < n
    if layout.vector and not 0 < total[layout.width] < n:
        used[layout.width] = False
    if spec.columns is not None:
        for c in set(layout.columns).difference(spec.columns):
            used[layout.at(c)] = False
            if c in layout.nullable:
                used[layout.flag(c)] = False
    if layout.vector and not spec.with_vector:
        used[: layout.width + 1] = False
    mean = total / max(n, 1.0)
    spread = np.sqrt(np.maximum(squares / max(n, 1.0) - mean**2, 0.0))
    spread = np.where(spread > 1e-9 * (1 + np.abs(mean)), spread, 1.0)
    mean[-1], spread[-1] = 0.0, 1.0
    matrix = np.diag(1 / spread)
    matrix[:-1, -1] = -(mean / spread)[:-1]
    for c in layout.nullable:
        matrix[layout.at(c), layout.flag(c)] = median.get(c, 0.0) / spread[layout.at(c)]
    matrix[~used] = 0.0
    return Preparation(mean, spread, {c: float(median.get(c, 0.0)) for c in layout.nullable}, counts, used, float(ones), float(n), matrix)


def prepare(rows: DataFrame, layout: Layout, specs: list[Spec], folds: int) -> list[Preparation]:
    repeats = 1 + max(s.repeat for s in specs)
    each = moments(rows, layout, repeats, folds)
    found = medians(rows, layout, sorted({s.out for s in specs}))
    out = []
    for s in specs:
        sums = each[s.repeat].sum(0) - (each[s.repeat, s.out] if s.out >= 0 else 0.0)
        out.append(preparation(layout, sums, {c: found[s.repeat, s.out, c] for c in layout.nullable if (s.repeat, s.out, c) in found}, s))
    return out


def newton(state: Broadcast, size: int):
    """From a model's sums over z the value at its weights, and the weights after a Newton step."""

    def step(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        sums = np.frombuffer(table.column("sums")[0].as_py(), np.float64)
        matrix, used, w, c = state.value[key]
        own = np.flatnonzero(used)
        t = matrix[own]
        penalty = np.ones(len(own))
        penalty[-1] = 0.0  # the intercept
        bend = c * (t @ sums[: size * size].reshape(size, size) @ t.T) + np.diag(penalty + 1e-12)
        slope = c * (t @ sums[size * size : -1]) + penalty * w[own]
        new = w.copy()
        new[own] -= np.linalg.solve(bend, slope)
        value = c * sums[-1] + 0.5 * float((penalty * w[own] ** 2).sum())
        return pa.table({"key": pa.array([key], pa.int32()), "value": pa.array([value]), "weights": pa.array([new.tolist()], pa.list_(pa.float64()))})

    return step


def fit_all(rows: DataFrame, layout: Layout, specs: list[Spec], folds: int = 1) -> tuple[list[Preparation], np.ndarray]:
    """Preparations and weights over prepared features of balanced logistic models with penalty |w|^2 / 2 against C times the loss.

    rows: the layout's columns, truth (0 or 1) and folds (the row's fold in each repeat), stored."""
    spark, size, count = rows.sparkSession, layout.size, len(specs)
    made = prepare(rows, layout, specs, folds)
    repeat, out_fold = np.array([s.repeat for s in specs]), np.array([s.out for s in specs])
    # balanced: n / (2 n_class) for the rows of a class
    weight = np.array([[p.rows / (2 * (p.rows - p.ones)) if p.rows > p.ones else 0.0, p.rows / (2 * p.ones) if p.ones else 0.0] for p in made])
    one_class = np.array([p.ones in (0.0, p.rows) for p in made])
    weights, before = np.zeros((count, size)), np.zeros((count, size))
    reached, open_ = np.full(count, np.inf), ~one_class
    for _ in range(PASSES):
        if not open_.any():
            break
        rows_open = np.flatnonzero(open_)
        raw = np.stack([made[m].matrix.T @ weights[m] for m in rows_open], axis=1)
        alike: dict[bytes, list[int]] = {}
        for i, m in enumerate(rows_open):
            alike.setdefault((made[m].matrix != 0).any(0).tobytes(), []).append(i)
        views = [(np.flatnonzero(np.frombuffer(k, bool)), np.array(v)) for k, v in alike.items()]
        sent = spark.sparkContext.broadcast((raw, repeat[rows_open], out_fold[rows_open], weight[rows_open], views))

        def run(batches, sent=sent):
            v, r, o, w, views = sent.value
            sums = np.zeros((v.shape[1], size * size + size + 1))
            for b in batches:
                z, y, fold = layout.numbers(b), b.column("truth").to_numpy(zero_copy_only=False).astype(np.int64), folds_of(b)
                margin = z @ v
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                each = np.where(fold[:, r] != o, w[:, y].T, 0.0)
                slope, bend = each * (p - y[:, None]), each * p * (1 - p)
                loss = each * (np.logaddexp(0, margin) - y[:, None] * margin)
                curvatures(z, bend, views, sums)
                sums[:, size * size : -1] += (z.T @ slope).T
                sums[:, -1] += loss.sum(0)
            yield emitted(sums)

        state = spark.sparkContext.broadcast([(made[m].matrix, made[m].used, weights[m], specs[m].c) for m in rows_open])

        for row in added(rows, run).groupBy("key").applyInArrow(newton(state, size), "key int, value double, weights array<double>").collect():
            m = rows_open[row.key]
            if row.value > reached[m] * (1 + 1e-12) + 1e-12:  # too far: back half the way
                weights[m] = (weights[m] + before[m]) / 2
                continue
            new = np.array(row.weights)
            open_[m] = np.abs(new - weights[m]).max() > CLOSE
            before[m], reached[m], weights[m] = weights[m], row.value, new
        sent.unpersist()
        state.unpersist()
    return made, weights


def cross_validated(rows: DataFrame, layout: Layout, specs: list[Spec], folds: int, id_column: str = "report_id") -> DataFrame:
    """(id, truth, model, repeat, fold, c, score): every row scored, in each repeat, by the models that left its fold out.

    rows: id, truth, folds and the layout's columns; stored."""
    made, weights = fit_all(rows, layout, specs, folds)
    raw = np.stack([p.matrix.T @ w for p, w in zip(made, weights, strict=True)], axis=1)
    sent = rows.sparkSession.sparkContext.broadcast((raw, [asdict(s) for s in specs]))

    def run(batches):
        v, known = sent.value
        for b in batches:
            scores = 1 / (1 + np.exp(-np.clip(layout.numbers(b) @ v, -500, 500)))
            fold = folds_of(b)
            for m, s in enumerate(known):
                own = np.flatnonzero(fold[:, s["repeat"]] == s["out"])
                some = pa.array(own)
                n = len(own)
                columns = [b.column(id_column).take(some), b.column("truth").take(some), pa.array([s["name"]] * n, pa.string()), pa.array(np.full(n, s["repeat"] + 1), pa.int32()), pa.array(np.full(n, s["out"]), pa.int32()), pa.array(np.full(n, s["c"])), pa.array(scores[own, m])]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "truth", "model", "repeat", "fold", "c", "score"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{id_column} {kind[id_column]}, truth {kind['truth']}, model string, repeat int, fold int, c double, score double")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass
class Package:
    """A fitted model with all that its scores need; it is saved as one JSON document."""

    name: str
    columns: list[str]
    kinds: dict[str, str]  # of the columns and the vector, as they were in training
    nullable: list[str]
    vector: str | None
    width: int
    c: float
    threshold: float
    features: list[dict]  # name, kept, values, median, mean, deviation, weight
    raw: list[float]  # weights over z

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Package:
        return cls(**json.loads(spark.read.text(folder).first().value))

    def broken(self, df: DataFrame) -> list[str]:
        """What keeps the package from scoring a table: missing columns and changed types."""
        there = dict(df.dtypes)
        wanted = [*self.columns, *([self.vector] if self.vector else [])]
        missing = [f"{c} is missing" for c in wanted if c not in there]
        return missing + [f"{c} is {there[c]}, not {self.kinds[c]}" for c in wanted if c in there and there[c] != self.kinds[c]]

    def margin(self) -> Column:
        layout = Layout(tuple(self.columns), tuple(self.nullable), self.vector, self.width)
        terms = [F.lit(self.raw[-1])]
        if self.vector:
            v = F.col(self.vector)
            weights = F.array(*[F.lit(float(x)) for x in self.raw[: self.width]]).cast("array<double>")
            flat = F.aggregate(F.zip_with(v, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
            right = F.when(F.size(v) == self.width, flat).otherwise(F.raise_error(F.lit(f"a vector's width is not {self.width}")))
            terms.append(F.when(v.isNull(), F.lit(self.raw[self.width])).otherwise(right))
        for c in self.columns:
            known = F.col(c).cast("double") * F.lit(self.raw[layout.at(c)])
            terms.append(F.coalesce(known, F.lit(self.raw[layout.flag(c)] if c in self.nullable else 0.0)))
        return reduce(add, terms)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of class one; a table that doesn't fit the package is refused."""
        broken = self.broken(df)
        if broken:
            raise ValueError(f"package {self.name}: {'; '.join(broken)}")
        return df.withColumn(name, 1 / (1 + F.exp(-self.margin())))


def fit_package(rows: DataFrame, columns: list[str], vector: str | None = None, c: float = 1.0, threshold: float = 0.5, name: str = "model") -> Package:
    """A package fitted on all rows with a truth. Null columns and vectors are allowed, as in `Layout`."""
    kinds = dict(rows.dtypes)
    wrong = [x for x in columns if kinds[x] not in NUMBERS]
    if wrong:
        raise ValueError(f"not numbers: {', '.join(wrong)}")
    known = stored(rows.where("truth is not null").select(*columns, *([vector] if vector else []), "truth", F.array(F.lit(0)).alias("folds")), "training-rows")
    layout = layout_of(known, columns, vector)
    spec = Spec(name, c=c)
    (made,), (weights,) = fit_all(known, layout, [spec])
    features = []
    for i, feature in enumerate(layout.names()):
        plain = feature in columns
        features.append(
            {
                "name": feature, "kept": bool(made.used[i]), "values": int(made.counts[columns.index(feature)]) if plain else int(made.rows),
                "median": made.median.get(feature) if plain else None, "mean": float(made.mean[i]), "deviation": float(made.spread[i]), "weight": float(weights[i]),
            }
        )
    fields = [*columns, *([vector] if vector else [])]
    return Package(name, list(columns), {x: kinds[x] for x in fields}, list(layout.nullable), vector, layout.width, c, threshold, features, (made.matrix.T @ weights).tolist())
