"""Evaluation over score tables: metrics, thresholds, folds, bootstrap, splits, comparisons.

Everything works on histograms of scores or on confusion counts, never on thresholds times rows."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.functions.ordered import join_groups, with_row_number, with_running_sums
from hazardloom.session import materialise


def f2_score(tp: Column, fp: Column, fn: Column) -> Column:
    whole = 5 * tp + 4 * fn + fp
    return F.when(whole == 0, F.lit(0.0)).otherwise(5 * tp / whole)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds n, accuracy, precision, recall and F2 to tp, fp, fn, tn counts; zero where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.withColumns(
        {
            "n": n,
            "accuracy": F.round(_ratio(tp + tn, n), 9),
            "precision": F.round(_ratio(tp, tp + fp), 9),
            "recall": F.round(_ratio(tp, tp + fn), 9),
            "f2": F.round(f2_score(tp, fp, fn), 9),
        }
    )


def confusion(predicted: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(predicted & (truth == 1)).alias("tp"),
        F.count_if(predicted & (truth == 0)).alias("fp"),
        F.count_if(~predicted & (truth == 1)).alias("fn"),
        F.count_if(~predicted & (truth == 0)).alias("tn"),
    ]


def binary_metrics(df: DataFrame, score: str, truth: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    grouped = df.groupBy(*by) if by else df
    return with_metrics(grouped.agg(*confusion(F.col(score) >= threshold, F.col(truth))))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Step-wise average precision; rows with equal scores enter together."""
    steps = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    running = with_running_sums(steps, [F.desc("s")], {"cum_pos": "pos", "cum_all": "all"})
    gain = F.sum(F.col("pos") * (F.col("cum_pos") / F.col("cum_all")))
    return running.agg(F.round(_ratio(gain, F.sum("pos")), 9).alias("average_precision"), F.sum("pos").alias("positives"), F.sum("all").alias("n"))


def _with_rates(table: DataFrame, positives: Column, negatives: Column) -> DataFrame:
    counts = table.withColumns({"fn": positives - F.col("tp"), "tn": negatives - F.col("fp")})
    return with_metrics(counts)


def threshold_table(df: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """Metrics at every threshold of a fixed grid: scores fall into grid cells, cells are summed from the top."""
    edges = F.array(*[F.lit(float(t)) for t in grid])
    histogram = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    cells = histogram.groupBy(F.size(F.filter(edges, lambda t: t <= F.col("s"))).alias("cell")).agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    axis = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("cell"))
    full = axis.join(F.broadcast(cells), "cell", "left").fillna(0, ["pos", "all"])  # one row per grid cell
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = full.select(
        "cell",
        F.sum("pos").over(above).alias("tp"),
        (F.sum("all").over(above) - F.sum("pos").over(above)).alias("fp"),
        F.sum("pos").over(whole).alias("_p"),
        (F.sum("all").over(whole) - F.sum("pos").over(whole)).alias("_n"),
    ).where("cell > 0")
    rated = _with_rates(summed, F.col("_p"), F.col("_n"))
    return rated.withColumn("threshold", F.element_at(edges, F.col("cell"))).drop("cell", "_p", "_n")


def best_threshold(table: DataFrame, precision_floor: float = 0.5) -> DataFrame:
    """Best row by F2, recall, precision, lower threshold, among those reaching the precision floor if any does."""
    return table.orderBy(
        F.desc((F.col("precision") >= precision_floor).cast("int")), F.desc("f2"), F.desc("recall"), F.desc("precision"), "threshold"
    ).limit(1)


def best_threshold_oof(df: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """Search over the grid and every score; equal F2 goes to the higher threshold."""
    s = F.col(score)
    rows = df.groupBy(s.alias("v")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    marks = rows.select(F.round("v", 6).alias("v")).distinct()
    fixed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("v"))
    marked = marks.unionByName(fixed).distinct().select("v", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("all"), F.lit(1).alias("mark"))
    events = rows.withColumn("mark", F.lit(0)).unionByName(marked)
    events = events.groupBy("v").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"), F.max("mark").alias("mark"))
    running = with_running_sums(events, [F.desc("v")], {"tp": "pos", "cum_all": "all"})
    positives, whole = rows.agg(F.sum("pos")).scalar(), rows.agg(F.sum("all")).scalar()
    table = running.where("mark = 1").withColumn("fp", F.col("cum_all") - F.col("tp"))
    rated = _with_rates(table, positives, whole - positives)
    return rated.orderBy(F.desc("f2"), F.desc("v")).limit(1).select(F.col("v").alias("threshold"), "f2", "precision", "recall", "fp", "fn")


def hash_number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def stratified_folds(df: DataFrame, truth: str, folds: int = 5, repeats: int = 10, id_column: str = "report_id") -> DataFrame:
    """(id, repeat, fold): rows in (repeat, class, hash) order are dealt to folds in turn."""
    rows = df.select(F.col(id_column), F.col(truth)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.withColumn("_h", hash_number(F.col("repeat"), F.col(id_column)))
    dealt = with_row_number(rows, [F.col(c) for c in ("repeat", truth, "_h", id_column)], "_no")
    return dealt.select(id_column, truth, "repeat", (F.col("_no") % folds).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, truth: str, folds: int = 5, repeats: int = 10) -> DataFrame:
    """As stratified_folds, but groups are dealt by majority label, so no group spans two folds."""
    groups = df.groupBy(group).agg((F.avg(truth) >= 0.5).cast("int").alias("_major"), F.count(F.lit(1)).alias("_rows"))
    dealt = stratified_folds(groups, "_major", folds, repeats, group)
    places = dealt.groupBy(group).agg(F.collect_list(F.struct("repeat", "fold")).alias("_places"))  # one entry per repeat
    sized = places.join(groups.select(group, "_rows"), group)
    rows = join_groups(df.select("report_id", group, truth), sized, group, "_rows").withColumn("_x", F.explode("_places"))
    return rows.select("report_id", group, truth, "_x.repeat", "_x.fold")


def oof_scores(df: DataFrame, repeats: int) -> DataFrame:
    """Mean out-of-fold score per record and whether all repeats are there."""
    out = df.groupBy("report_id").agg(F.round(F.avg("score"), 9).alias("oof_score"), F.count(F.lit(1)).alias("parts"))
    return out.withColumn("complete", F.col("parts") == repeats)


def group_safe_split(df: DataFrame, group: str, label: str) -> DataFrame:
    """70/15/15 by group within label mix, in hash order."""
    groups = df.groupBy(group).agg(
        F.when(F.min(label) == F.max(label), F.min(label)).otherwise("MIXED").alias("stratum"), F.count(F.lit(1)).alias("_rows")
    )
    numbered = with_row_number(
        groups.withColumn("_h", hash_number(F.lit("split"), F.col(group))), [F.col("stratum"), F.col("_h"), F.col(group)], "_no"
    )
    sizes = numbered.groupBy("stratum").agg(F.count(F.lit(1)).alias("_size"), F.min("_no").alias("_first"))
    share = (F.col("_no") - F.col("_first")) / F.col("_size")
    split = F.when(share < 0.70, "train").when(share < 0.85, "validation").otherwise("test")
    assigned = numbered.join(F.broadcast(sizes), "stratum").select(group, "stratum", "_rows", split.alias("split"))  # three strata
    return join_groups(df, assigned, group, "_rows").drop("_rows")


#: Shares of the splits, in the order in which ties are decided, and weights of the errors of rows, YES and NO.
GREEDY_SHARES = (("test", 0.15), ("validation", 0.15), ("train", 0.70))
GREEDY_WEIGHTS = (0.55, 0.25, 0.20)
STRETCH = 1 << 16  # decisions that are worked out at a time
SURE = 1e-9  # far above the rounding of an error


def greedy_errors(totals: np.ndarray, size: np.ndarray, targets: np.ndarray, first: int, n: int, weights=GREEDY_WEIGHTS) -> np.ndarray:
    """[split, i]: the weighted relative error of a split that holds first + i + 1 groups of a class more than `totals`."""
    grown = totals[:, :, None] + size[None, :, None] * np.arange(first + 1, first + n + 1)[None, None, :]
    each = np.abs(grown - targets[:, :, None]) / np.maximum(targets, 1.0)[:, :, None]
    return weights[0] * each[:, 0] + weights[1] * each[:, 1] + weights[2] * each[:, 2]


def greedy_picks(totals: np.ndarray, size: np.ndarray, targets: np.ndarray, n: int, weights=GREEDY_WEIGHTS) -> np.ndarray:
    """The splits that the next n groups of a class go to. A split's error depends on its own groups only, so the decisions are a merge
    of one list of errors for each split: in the order of the largest error so far, then of the split."""
    peaks = np.maximum.accumulate(greedy_errors(totals, size, targets, 0, n, weights), axis=1)
    split = np.repeat(np.arange(len(totals)), n)
    return split[np.lexsort((split, peaks.ravel()))[:n]]


def greedy_stretches(classes: list[tuple[int, int, int, int]], shares=GREEDY_SHARES, weights=GREEDY_WEIGHTS) -> tuple[list[tuple], np.ndarray]:
    """(class, first, end, split, totals before) over ranks within classes, and the targets; split is -1 where the decisions change
    within a stretch, which `greedy_picks` tells from the totals. As an error is convex in the groups a split has, many alike groups
    go to a split at once while its error stays clearly below the others'."""
    whole = np.array([[c[k] * c[3] for k in range(3)] for c in classes], np.int64).sum(0).astype(float) if classes else np.zeros(3)
    targets = np.array([whole * share for _, share in shares])
    totals, out = np.zeros(targets.shape, np.int64), []
    for i, (*counts, groups) in enumerate(classes):
        size, at = np.array(counts, np.int64), 0
        while at < groups:
            n = min(STRETCH, groups - at)
            picks = greedy_picks(totals, size, targets, n, weights)
            best = int(picks[0])
            if (picks != best).any():
                out.append((i, at, at + n, -1, totals.copy()))
                totals += np.bincount(picks, minlength=len(shares))[:, None] * size
            else:
                error = lambda k: greedy_errors(totals, size, targets, k - 1, 1, weights)[best, 0]
                others = np.delete(greedy_errors(totals, size, targets, 0, 1, weights)[:, 0], best).min() - SURE
                if error(n) < others:
                    low, high = n, groups - at
                    while low < high:
                        middle = (low + high + 1) // 2
                        low, high = (middle, high) if error(middle) < others else (low, middle - 1)
                    n = low
                out.append((i, at, at + n, best, totals.copy()))
                totals[best] += n * size
            at += n
    return out, targets


def _runs_of(stretch: tuple, classes: list, targets: np.ndarray) -> list[tuple[int, int, int, int]]:
    c, first, end, split, totals = stretch
    if split >= 0:
        return [(c, first, end, split)]
    picks = greedy_picks(totals, np.array(classes[c][:3], np.int64), targets, end - first)
    cuts = [0, *(np.flatnonzero(np.diff(picks)) + 1).tolist(), len(picks)]
    return [(c, first + a, first + b, int(picks[a])) for a, b in zip(cuts, cuts[1:])]


def greedy_plan(classes: list[tuple[int, int, int, int]], shares=GREEDY_SHARES) -> tuple[list[tuple], np.ndarray]:
    """The stretches, after which an empty split takes the last group of the fullest one."""
    plan, targets = greedy_stretches(classes, shares)
    held = np.zeros(len(shares), np.int64)
    for c, a, b, split, totals in plan:
        picked = np.bincount(greedy_picks(totals, np.array(classes[c][:3], np.int64), targets, b - a), minlength=len(shares)) if split < 0 else (b - a) * np.eye(len(shares), dtype=np.int64)[split]
        held += picked * classes[c][0]
    for empty in range(len(shares))[::-1]:
        if not plan or held[empty]:
            continue
        donor = max(range(len(shares))[::-1], key=lambda s: held[s])
        for k in range(len(plan))[::-1]:
            runs = _runs_of(plan[k], classes, targets)
            if any(r[3] == donor for r in runs):
                break
        j = max(n for n, r in enumerate(runs) if r[3] == donor)
        c, a, b, _ = runs[j]
        runs[j : j + 1] = [(c, a, b - 1, donor)] * (b - a > 1) + [(c, b - 1, b, empty)]
        plan[k : k + 1] = [(*r, None) for r in runs]
        held[donor], held[empty] = held[donor] - classes[c][0], classes[c][0]
    return plan, targets


def greedy_runs(classes: list[tuple[int, int, int, int]], shares=GREEDY_SHARES) -> list[tuple[int, int, int, str]]:
    """(class, first, end, split) over ranks within classes: each group goes to the split whose weighted relative error it makes
    least. classes: (rows, yes, no, groups), those of large and one-sided groups first."""
    plan, targets = greedy_plan(classes, shares)
    runs = []
    for c, a, b, split in (r for stretch in plan for r in _runs_of(stretch, classes, targets)):
        if runs and runs[-1][0] == c and runs[-1][3] == shares[split][0]:
            runs[-1] = (c, runs[-1][1], b, shares[split][0])
        else:
            runs.append((c, a, b, shares[split][0]))
    return runs


def greedy_group_split(df: DataFrame, group: str, label: str) -> DataFrame:
    """Group-safe split by the greedy rule on rows, YES and NO, a group at a time. The driver walks over classes of groups with equal
    counts, as a class's groups are alike to the rule, and keeps totals only; stretches in which the decisions change are worked out
    again by the tasks. Within a class, groups are taken in hash order."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(label) == "YES").alias("_yes"), F.count_if(F.col(label) == "NO").alias("_no"))
    size = ["_rows", "_yes", "_no"]
    known = groups.groupBy(*size).agg(F.count(F.lit(1)).alias("_groups")).orderBy(F.desc("_rows"), F.desc(F.abs(F.col("_yes") - F.col("_no"))), F.desc("_yes")).collect()
    classes = [tuple(r) for r in known]
    before = np.concatenate([[0], np.cumsum([c[3] for c in classes])]).astype(int).tolist()
    plan, targets = greedy_plan(classes)
    names = [s for s, _ in GREEDY_SHARES]
    plain = [(*classes[c][:3], before[c] + a, before[c] + b, names[s]) for c, a, b, s, _ in plan if s >= 0]
    mixed = [(before[c] + a, b - a, list(classes[c][:3]), totals.ravel().tolist()) for c, a, b, s, totals in plan if s < 0]

    def picked(batches):
        for batch in batches:
            for x in batch.to_pylist():
                picks = greedy_picks(np.array(x["totals"], np.int64).reshape(targets.shape), np.array(x["size"], np.int64), targets, x["n"])
                numbers = x["first"] + 1 + np.arange(x["n"])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(names).take(pa.array(picks))], ["_no_", "split"])

    order = [F.desc("_rows"), F.desc(F.abs(F.col("_yes") - F.col("_no"))), F.desc("_yes"), F.col("_h"), F.col(group)]
    numbered = with_row_number(groups.withColumn("_h", hash_number(F.lit("split"), F.col(group))), order, "_no_")
    spark = df.sparkSession
    table = spark.createDataFrame(plain, "_rows long, _yes long, _no long, _from long, _end long, split string")
    inside = (F.col("_no_") > F.col("_from")) & (F.col("_no_") <= F.col("_end"))
    assigned = numbered.join(F.broadcast(table), size).where(inside).select(group, "_rows", "split")  # a few stretches for each class
    if mixed:
        rest = spark.createDataFrame(mixed, "first long, n long, size array<long>, totals array<long>")
        rest = rest.repartition(min(len(mixed), 64)).mapInArrow(picked, "_no_ long, split string")
        assigned = assigned.unionByName(numbered.join(rest, "_no_").select(group, "_rows", "split"))
    return join_groups(df, assigned, group, "_rows").drop("_rows")


def pairwise_overlap(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(a, b, shared) for every two tables: keys that both have. A key's tables are bits of one number, keys are counted by that
    number, and only those few counts are spread to pairs."""
    names = list(tables)
    parts = [df.select(F.col(key).alias("k")).where(F.col(key).isNotNull()).withColumn("bit", F.lit(1 << i).cast("long")) for i, df in enumerate(tables.values())]
    masks = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << i | 1 << j).cast("long").alias("both")) for j, b in enumerate(names) for i, a in enumerate(names[:j])])
    spread = masks.select(F.explode(pairs).alias("x"), "mask", "n").select("x.a", "x.b", F.when(F.col("mask").bitwiseAND(F.col("x.both")) == F.col("x.both"), F.col("n")).otherwise(0).alias("n"))
    return spread.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def split_profile(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per split: rows, positives, rate, groups, and an order-free signature of the ids. The ids stay
    rows: their digests are added up, so no list of a whole split is ever built."""
    digest = F.conv(F.substring(F.sha2("report_id", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(label) == "YES").alias("yes"),
        F.countDistinct(group).alias("groups"),
        F.min("report_id").alias("first_id"),
        F.max("report_id").alias("last_id"),
        F.sum(digest).cast("string").alias("id_sum"),
    )
    rate = F.round(F.col("yes") / F.col("records"), 9)
    return rows.withColumns({"yes_rate": rate, "signature": F.sha2("id_sum", 256)}).drop("id_sum")


def split_leakage(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, splits) of ids or groups found in more than one split."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    long = df.select(F.explode(pairs).alias("x"), "split").select("x.key", "x.value", "split").distinct()
    return long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


def fold_summary(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per metric over the fold rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select(*by, F.explode(pairs).alias("x")).select(*by, "x.metric", "x.value")
    return long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def model_deltas(summary: DataFrame, base: str) -> DataFrame:
    """Difference of every model's mean to the base model's, per metric."""
    reference = summary.where(F.col("model") == base).select("metric", F.col("mean").alias("base_mean"))
    return summary.join(reference, "metric").select("model", "metric", "mean", F.round(F.col("mean") - F.col("base_mean"), 9).alias("delta"))


def score_consistency(a: DataFrame, b: DataFrame, exact: float = 1e-5, tolerance: float = 1e-3) -> DataFrame:
    """Largest and mean absolute difference of two score tables with a verdict."""
    gap = F.abs(F.col("a") - F.col("b"))
    joined = a.join(b, "report_id").agg(F.count(F.lit(1)).alias("records"), F.max(gap).alias("_max"), F.round(F.avg(gap), 9).alias("mean_abs_diff"))
    status = F.when(F.col("_max") < exact, "PASS_EXACT").when(F.col("_max") < tolerance, "PASS_NUMERIC_TOLERANCE").otherwise("FAIL")
    return joined.withColumns({"max_abs_diff": F.round("_max", 9), "status": status}).drop("_max")


#: Arithmetic of the draws: a prime, so that products of two remainders fit a long.
PRIME = 2**31 - 1
CELLS = 512  # scores of a block
SMALL = 200  # mean up to which a count is looked up in its distribution; above, it comes from a normal draw
_DISTRIBUTIONS: dict[int, np.ndarray] = {}


def distribution(n: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable of mean n, as far as they differ from one."""
    if n not in _DISTRIBUTIONS:
        last = n + int(12 * math.sqrt(n)) + 20
        _DISTRIBUTIONS[n] = np.cumsum([math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in range(last)])
    return _DISTRIBUTIONS[n]


def replicate_numbers(reps: int) -> np.ndarray:
    """Four numbers for each replicate."""
    digests = [hashlib.md5(str(r).encode()).hexdigest() for r in range(1, reps + 1)]
    return np.array([[int(d[8 * k : 8 * k + 8], 16) % PRIME for k in range(4)] for d in digests], np.int64)


def uniforms(seeds: np.ndarray, numbers: np.ndarray, pair: int) -> np.ndarray:
    """[cell, replicate]: numbers in (0, 1) that a cell's seed and a replicate's numbers give."""
    x = (seeds[:, None] * numbers[None, :, 2 * pair] + numbers[None, :, 2 * pair + 1]) % PRIME
    x = (x * x % PRIME * x + seeds[:, None]) % PRIME
    return (x + 0.5) / PRIME


def poisson_counts(n: np.ndarray, seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """[cell, replicate]: how often the n rows of a cell are drawn, a Poisson count of mean n."""
    out = np.zeros((len(n), len(numbers)), np.int64)
    for value in np.unique(n[(n > 0) & (n <= SMALL)]).tolist():
        own = np.flatnonzero(n == value)
        out[own] = np.searchsorted(distribution(value), uniforms(seeds[own], numbers, 0), "right")
    own = np.flatnonzero(n > SMALL)
    if len(own):
        z = np.sqrt(-2 * np.log(uniforms(seeds[own], numbers, 0))) * np.cos(2 * np.pi * uniforms(seeds[own], numbers, 1))
        mean = n[own][:, None]
        out[own] = np.maximum(0, np.rint(mean + np.sqrt(mean) * z + (z * z - 1) / 6)).astype(np.int64)
    return out


def _drawn(table: pa.Table, reps: int):
    """Cells of a block by falling score, with the draws of class one and of all rows, a part of the replicates at a time."""
    order = np.argsort(table.column("i").to_numpy())
    i, pos, rows, s = (table.column(c).to_numpy()[order] for c in ("i", "pos", "all", "s"))
    numbers, step = replicate_numbers(reps), max(1, (1 << 21) // max(1, len(i)))
    for at in range(0, reps, step):
        part = numbers[at : at + step]
        ones = poisson_counts(pos, (2 * i + 1) % PRIME, part)
        yield at, s, ones, ones + poisson_counts(rows - pos, 2 * i % PRIME, part)


def _ahead(each: DataFrame) -> DataFrame:
    """Per block and replicate the sums of the blocks before it."""
    ahead = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"before_{c}") for c in ("pos", "all")])


def _before(table: pa.Table) -> list[np.ndarray]:
    order = np.argsort(table.column("rep").to_numpy())
    return [table.column(c).to_numpy()[order] for c in ("before_pos", "before_all")]


def _cells_drawn(df: DataFrame, score: str, truth: str, threshold: float, reps: int) -> tuple[DataFrame, DataFrame]:
    """Sums and gains of the replicates for rows without an id: one number for each score and class, as the Poisson weights of equal rows
    add up to a Poisson count. Scores are numbered from the highest down and cut into blocks."""
    cells = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    ranked = with_row_number(cells, [F.desc("s")], "i")
    cells = materialise(ranked.select("i", "s", "pos", "all", ((F.col("i") - 1) / CELLS).cast("long").alias("block")))

    def sums(table: pa.Table) -> pa.Table:
        parts, block = [], table.column("block")[0].as_py()
        for at, s, ones, rows in _drawn(table, reps):
            hit = s >= threshold
            parts.append([np.arange(at + 1, at + 1 + ones.shape[1]), ones.sum(0), rows.sum(0), ones[hit].sum(0), (rows - ones)[hit].sum(0)])
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]
        return pa.table([np.full(reps, block, np.int64), *columns], names=["block", "rep", "pos", "all", "tp", "fp"])

    def gains(table: pa.Table, before: pa.Table) -> pa.Table:
        ahead, gain = _before(before), np.zeros(reps)
        for at, _, ones, rows in _drawn(table, reps):
            part = slice(at, at + ones.shape[1])
            up, down = np.cumsum(ones, axis=0) + ahead[0][part], np.cumsum(rows, axis=0) + ahead[1][part]
            gain[part] = (ones * (up / np.maximum(down, 1))).sum(0)
        return pa.table([np.arange(1, reps + 1), gain], names=["rep", "gain"])

    each = materialise(cells.groupBy("block").applyInArrow(sums, "block long, rep long, pos long, all long, tp long, fp long"))
    return each, cells.groupBy("block").cogroup(_ahead(each).groupBy("block")).applyInArrow(gains, "rep long, gain double")


#: Bounds of a draw of 32 bits from which on a row counts 1, 2, ... times.
POISSON = np.array([math.ceil(c * 2**32) for c in accumulate(math.exp(-1) / math.factorial(k) for k in range(12)) if c * 2**32 <= 2**32 - 1], np.uint32)
DRAWS = 4  # draws of 32 bits in one md5
BLOCK_ROWS = 1024


TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def md5_words(texts: np.ndarray) -> np.ndarray:
    """[4, n]: the four words of each text's md5, as big-endian numbers. texts: [n, 64] bytes, padded as md5 has it (55 bytes of text at most)."""
    m = np.ascontiguousarray(texts.view("<u4").T)
    first = [np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += SINES[i]
        turn = TURNS[i]
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> np.uint32(32 - turn)))
    return np.stack([x + y for x, y in zip(first, (a, b, c, d), strict=True)]).byteswap()


def row_weights(names: list[str], reps: int) -> np.ndarray:
    """[row, replicate]: Poisson weights from the digests of "block|id", each of which serves the replicates of a block."""
    own, blocks = [f"|{x}".encode() for x in names], -(-reps // DRAWS)
    draws = np.empty((len(own), blocks, DRAWS), np.uint32)
    for digits in range(1, len(str(blocks)) + 1):
        low, high = 10 ** (digits - 1) if digits > 1 else 0, min(10**digits, blocks)
        fits = [k for k, x in enumerate(own) if digits + len(x) < 56]
        texts = np.zeros((len(fits), high - low, 64), np.uint8)
        texts[:, :, :digits] = np.frombuffer(b"".join(b"%d" % k for k in range(low, high)), np.uint8).reshape(-1, digits)
        for at, k in enumerate(fits):
            n = digits + len(own[k])
            texts[at, :, digits:n] = np.frombuffer(own[k], np.uint8)
            texts[at, :, n] = 0x80
            texts[at, :, 56:58] = (8 * n & 255, 8 * n >> 8)
        if fits:
            draws[fits, low:high] = md5_words(texts.reshape(-1, 64)).T.reshape(len(fits), high - low, DRAWS)
        for k in set(range(len(own))).difference(fits):  # longer than one step of md5
            digests = b"".join([hashlib.md5(b"%d" % block + own[k]).digest() for block in range(low, high)])
            draws[k, low:high] = np.frombuffer(digests, ">u4").reshape(-1, DRAWS)
    flat = draws.reshape(len(own), -1)[:, :reps]
    out = np.zeros(flat.shape, np.uint8)
    for bound in POISSON:
        out += flat >= bound
    return out


def _weighed(names: list[str], reps: int, rows: int = 32):
    """Each row's weights, some rows at a time."""
    for at in range(0, len(names), rows):
        yield from row_weights(names[at : at + rows], reps)


def _rows_drawn(df: DataFrame, score: str, truth: str, threshold: float, reps: int, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Sums and gains of the replicates, every row drawn in each of them. Scores are cut into blocks of about `BLOCK_ROWS` rows from the
    highest down; a score of more rows is a block of its own, which is spread over slices and whose gain follows from its sums."""
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(score).cast("double").alias("s"), F.col(truth).cast("long").alias("y"))
    cells = with_running_sums(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")), [F.desc("s")], {"to": "n"})
    hot = F.col("n") > BLOCK_ROWS
    cells = cells.select("s", "n", (2 * F.floor((F.col("to") - F.col("n")) / BLOCK_ROWS) + hot.cast("long")).alias("block"))
    part = F.when(hot, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS))).otherwise(0)
    rows = materialise(join_groups(rows, cells, "s", "n").select("id", "s", "y", "block", part.alias("part"), hot.alias("hot")))

    def sums(table: pa.Table) -> pa.Table:
        s, y = (table.column(c).to_numpy() for c in ("s", "y"))
        sums = np.zeros((4, reps), np.int64)
        for w, high, one in zip(_weighed(table.column("id").to_pylist(), reps), s >= threshold, y == 1, strict=True):
            sums[1] += w
            if one:
                sums[0] += w
            if high:
                sums[2 if one else 3] += w
        same = [np.full(reps, table.column(c)[0].as_py()) for c in ("block", "hot")]
        return pa.table([*same, np.arange(1, reps + 1), *sums], names=["block", "hot", "rep", "pos", "all", "tp", "fp"])

    def gains(table: pa.Table, before: pa.Table) -> pa.Table:
        up, down = (x.copy() for x in _before(before))
        s, y, names = table.column("s").to_numpy(), table.column("y").to_numpy(), table.column("id").to_pylist()
        order = np.argsort(-s, kind="stable")
        weights, gain = _weighed([names[k] for k in order], reps), np.zeros(reps)
        for cell in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
            ones = np.zeros(reps, np.int64)
            for k, w in zip(cell.tolist(), weights):  # noqa: B905
                down += w
                if y[k] == 1:
                    ones += w
            up += ones
            gain += ones * (up / np.maximum(down, 1))
        return pa.table([np.arange(1, reps + 1), gain], names=["rep", "gain"])

    drawn = rows.groupBy("block", "part").applyInArrow(sums, "block long, hot boolean, rep long, pos long, all long, tp long, fp long")
    each = materialise(drawn.groupBy("block", "hot", "rep").agg(*[F.sum(c).alias(c) for c in ("pos", "all", "tp", "fp")]))
    whole = _ahead(each)
    mixed = rows.where(~F.col("hot")).groupBy("block").cogroup(whole.where(~F.col("hot")).groupBy("block")).applyInArrow(gains, "rep long, gain double")
    share = (F.col("before_pos") + F.col("pos")) / F.greatest(F.col("before_all") + F.col("all"), F.lit(1))
    return each, mixed.unionByName(whole.where("hot").select("rep", (F.col("pos") * share).alias("gain")))


def bootstrap_ci(df: DataFrame, score: str, truth: str, threshold: float, reps: int, id_column: str | None = None) -> DataFrame:
    """Percentile intervals. With an id column every row draws its own Poisson weight in each replicate; rows without ids draw a count
    for each score and class. Blocks of scores draw all their replicates twice, first for their sums, then, with the sums of the
    blocks before them, for their part of the average precision."""
    each, gained = _rows_drawn(df, score, truth, threshold, reps, id_column) if id_column else _cells_drawn(df, score, truth, threshold, reps)
    gained = gained.groupBy("rep").agg(F.sum("gain").alias("gain"))
    counts = each.groupBy("rep").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("pos").alias("P"), F.sum("all").alias("N")).join(gained, "rep")
    counts = counts.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("P") - F.col("fp")})
    both = (F.col("P") > 0) & (F.col("P") < F.col("N"))
    rated = with_metrics(counts).withColumn("pr_auc", F.when(both, F.round(F.col("gain") / F.col("P"), 9)))
    names = ["accuracy", "precision", "recall", "f2", "pr_auc"]
    pairs = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])
    long = rated.select(F.explode(pairs).alias("x")).select("x.metric", "x.value").where("value IS NOT NULL")
    return long.groupBy("metric").agg(
        F.round(F.percentile("value", 0.025), 9).alias("ci_low"), F.round(F.percentile("value", 0.975), 9).alias("ci_high"),
        F.count(F.lit(1)).alias("valid_samples"),
    )


def grid_metrics(scores: DataFrame, grid: list[float], threshold: float = 0.5) -> DataFrame:
    """Per C of the scored rows (c, truth, score): precision, recall, F2 and average precision."""
    rates = binary_metrics(scores, "score", "truth", threshold, ["c"]).select("c", "precision", "recall", "f2")
    ranked = [average_precision(scores.where(F.col("c") == c), "score", "truth").select(F.lit(c).alias("c"), F.col("average_precision").alias("pr_auc")) for c in grid]
    return rates.join(reduce(DataFrame.unionByName, ranked), "c")


def select_best_c(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("f2"), F.desc("recall"), F.desc("pr_auc"), F.desc("precision"), "c").limit(1)


def queue_enrichment(tiers: DataFrame) -> DataFrame:
    """Cumulative records, positives, rate and recall over the five tiers."""
    up = Window.orderBy("review_priority").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("review_priority").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tiers.select(
        F.concat(F.lit("P1-"), F.col("review_priority")).alias("queue"),
        F.sum("records").over(up).alias("records"),
        F.sum("yes").over(up).alias("yes"),
        F.round(_ratio(F.sum("yes").over(up), F.sum("records").over(up)), 9).alias("gold_positive_rate"),
        F.round(_ratio(F.sum("yes").over(up), F.sum("yes").over(whole)), 9).alias("recall"),
    )


def ranking_at_k(df: DataFrame, score: str, truth: str, ks: list[int]) -> DataFrame:
    """Precision and recall of the first k rows by score; only the largest k rows are ranked."""
    top = df.orderBy(F.desc(score), "report_id").limit(max(ks))
    place = F.row_number().over(Window.orderBy(F.desc(score), "report_id"))  # at most max(ks) rows
    ranked = top.withColumn("place", place)
    positives = df.agg(F.sum(F.col(truth).cast("bigint"))).scalar()
    axis = F.explode(F.array(*[F.lit(k) for k in ks]))
    long = ranked.withColumn("k", axis).where("place <= k").groupBy("k").agg(F.avg(truth).alias("_p"), F.sum(truth).alias("_h"))
    return long.select("k", F.round("_p", 9).alias("precision_at_k"), F.round(_ratio(F.col("_h"), positives), 9).alias("recall_at_k"))


def priority_quartiles(df: DataFrame, score: str) -> DataFrame:
    """Q1 (lowest) to Q4 by the position of the score, ties by id, at the quartile cuts of the positions."""
    ranked = with_row_number(df, [F.col(score), F.col("report_id")], "place")
    n = df.agg(F.count(F.lit(1))).scalar()
    tier = F.greatest(F.lit(1), F.ceil(4 * (F.col("place") - 1) / (n - 1)))
    return ranked.withColumn("tier", tier.cast("int"))
