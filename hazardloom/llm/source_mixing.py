"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in the order of their names, weigh 5, 2, 1 and so on in turn and share a multiple of all words; a source whose share is
above twice its own words stops there, and the excess is shared by weight among the others until none is above. A document of a
source is wanted target / source_size times: so many whole copies, and a fraction that is rounded to 0 or 1.

Rounding keeps every document's probability and its source's words. Two fractional documents are paired: words move from one to
the other, either way, as many as bring one of the two to a whole number, with chances under which neither gains on average.
What is left of a pair meets the next document. Documents of a source are dealt out by hash into leaves of a few thousand; in a
leaf they meet in order of size, the longest first, so the last fraction stands on one of the shortest. Each leaf passes on that
one document, groups of leaves do the same with theirs, and so on up a tree until one fraction a source is left, which a coin
rounds: a source misses its target by less than that document's words. Coins are hashes of the documents, so runs agree, and a
task that runs again decides the same.

Only counts of sources reach one place: they are sorted as rows of a table. A hot source has more leaves, none larger.

Defined results: a null or empty text, or one without words, has size 0 and is taken 0 times; a null source is one source, the
last; a source without words has target 0; rows with equal ids are told apart by their texts, equal rows by nothing, as any of them
may be taken (they meet in one leaf); a null doc_id stays null; an empty table gives an empty one; other columns are neither read nor returned."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.functions.ordered import join_groups, with_row_number, with_running_sums
from hazardloom.llm.common import load, mapped, mix, slices, staged, text_bytes, texts_of, word_spans

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words that the mix takes
MOST = 2  # times a source's words at most
SEED = 42
LEAF = 1024  # documents that are paired in one group


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), key (hash of id and text): one slim row per document."""
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    rows = texts_of(docs, F.col("source").cast("string").alias("source"), key.alias("key"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                data, bounds = text_bytes(b.column("text"))
                n = np.diff(word_spans(data, bounds)[2])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), b.column("key")], ["doc_id", "source", "size", "key"])

    return mapped(rows, run, "doc_id long, source string, size long, key long")


def targets(found: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: source, source_size, weight, target, rows, n (those with words).

    In order of what a source can take per unit of weight, the sources that stop at their limit come first. With those before a
    source stopped, the rest share what is left by weight; the first source that this does not bring above its limit ends them."""
    spark = found.sparkSession
    each = found.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.count(F.lit(1)).alias("rows"))
    ranked = with_row_number(staged(each, "sources"), [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("limit", F.col("source_size") * most)
    ordered = with_running_sums(ranked.withColumn("per", F.col("limit") / F.col("weight")), [F.col("per"), F.col("place")], {"limits": "limit", "weighed": "weight"})
    ordered = staged(ordered, "targets")
    words, weighed = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    if words is None:
        return ordered.withColumn("target", F.lit(0.0))
    left = F.lit(float(words * share)) - (F.col("limits") - F.col("limit"))
    level = left / (F.lit(float(weighed)) - (F.col("weighed") - F.col("weight")))
    # the level never falls over the stopped sources, so the lowest place that holds is the right one
    open_ = ordered.withColumn("level", level).where(F.col("level") <= F.col("per")).agg(F.min_by("level", F.struct("per", "place"))).first()[0]
    return ordered.withColumn("target", F.least(F.col("limit").cast("double"), F.lit(float(open_)) * F.col("weight")) if open_ is not None else F.col("limit").cast("double"))


def coins(keys: np.ndarray, level: int) -> np.ndarray:
    """A number in (0, 1) per document and level of the tree."""
    x = mix(mix(keys.view(np.uint64) + np.uint64(level + 1)) ^ np.uint64(SEED))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def paired(size: np.ndarray, p: np.ndarray, key: np.ndarray, level: int, last: bool = False) -> np.ndarray:
    """The fractions of a group after its meetings, in the given order: all are 0 or 1 but one at most, none if `last`."""
    out, words, luck = p.tolist(), size.tolist(), coins(key, level).tolist()
    a = -1  # the one that is still open
    for b in range(len(out)):
        if not 0.0 < out[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        x, y, s, t = out[a], out[b], words[a], words[b]
        up, down = min((1.0 - x) * s, y * t), min(x * s, (1.0 - y) * t)  # words that can move to a, and away from it
        if luck[b] * (up + down) < down:
            if up == y * t:
                out[a], out[b] = min(1.0, x + up / s), 0.0
            else:
                out[a], out[b] = 1.0, max(0.0, y - up / t)
        elif down == x * s:
            out[a], out[b] = 0.0, min(1.0, y + down / t)
        else:
            out[a], out[b] = max(0.0, x - down / s), 1.0
        a = a if 0.0 < out[a] < 1.0 else b if 0.0 < out[b] < 1.0 else -1
    if last and a >= 0:
        out[a] = float(coins(key[a : a + 1], level + (1 << 20))[0] < out[a])
    return np.array(out, np.float64)


def meetings(level: int) -> Callable[[pa.Table], pa.Table]:
    """What a group of the tree's level does."""

    def meet(table: pa.Table) -> pa.Table:
        size, key, p = (table.column(c).to_numpy() for c in ("size", "key", "p"))
        order = np.lexsort((p, key, -size))
        out = np.empty(len(p))
        out[order] = paired(size[order], p[order], key[order], level, table.column("leaves")[0].as_py() == 1)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return meet


def rounded(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """rows with every p rounded to 0 or 1. They have source, size, key, p and n, the source's documents; other columns stay."""
    leaves = F.greatest(F.ceil(F.col("n") / leaf), F.lit(1)).cast("long")
    rows = rows.withColumn("leaf", F.pmod("key", leaves)).withColumn("leaves", leaves)
    schema, done, level = rows.schema, None, 0
    while True:
        met = staged(rows.groupBy("source", "leaf", "leaves").applyInArrow(meetings(level), schema), "rounding")
        whole = met.where(F.col("p").isin(0.0, 1.0))
        done = whole if done is None else done.unionByName(whole)
        rows = met.where(~F.col("p").isin(0.0, 1.0))
        if rows.isEmpty():
            return done
        level += 1
        up = F.ceil(F.col("leaves") / leaf).cast("long")
        rows = rows.withColumn("leaf", F.pmod("leaf", up)).withColumn("leaves", up)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, leaf: int = LEAF) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies."""
    found = staged(sizes(docs), "sizes")
    named = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("name")
    goals = targets(found, weights, share, most).select(named, "source_size", "target", "n", "rows")
    goals = staged(goals.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))), "goals")
    known = join_groups(found.select("*", named), goals, "name", "rows")
    known = known.withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("long")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)))
    known = known.select("doc_id", "source", "size", "source_size", "target", "whole", "key", "n", "p")
    drawn = rounded(known.where(F.col("p") > 0), leaf).select(known.columns)
    both = known.where(F.col("p") == 0).unionByName(drawn)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def op12(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(load(spark, sf_dir, "documents"))
