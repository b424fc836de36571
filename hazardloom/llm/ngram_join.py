"""Similarity join of word-shingle sets by vertical partitioning, and the groups that its links form.

The shingles' global order (by hash) is cut into fragments; a document's set falls into one segment
a fragment. Overlaps are counted segment by segment and summed per pair.

Only pairs that matter are counted, and no link between different sets is lost:

1. A set can have a link only if enough of its first shingles (in the global order) occur in other sets. A
   bitmap of fixed size, made from all documents, holds the shingles seen twice; a false one only lets a
   set through. Sets of equal shingles become one class, with its smallest doc_id.
   Classes are then looked at in full in the same way.
2. Classes that agree in one of a few minimum hashes, and in enough of the others, are compared with the smallest
   class of that agreement: a group of n near copies gives about n pairs, which mostly make it one component.
3. What is left are links between different components. Classes that met the same smallest class in step 2, linked with it or
   not, are a family. Within a family of several components every pair is looked at in blocks: a task has the sets of two blocks,
   counts the overlaps of all their pairs and passes on one link for each two components, so a large group of texts that are
   mostly less alike than the threshold makes no row per pair. Between families a shingle matters only if it is in classes of
   two families; classes whose share of such shingles is under the threshold go. The rest are compared in full where they
   share one of their rarest shingles: overlaps are counted fragment by fragment and summed per pair.
4. Every link lies within a component now. `link_counts` counts them all in the same kind of blocks. Only counts leave a group.

Defined results: a null or empty text has an empty set and no link; rows of equal doc_id are separate rows whose
sets join through equal ids only if they link; a component whose rows have no doc_id gets a null
component_id; an empty table gives an empty one; other columns are neither read nor returned by `op3`."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.llm.common import bitmap_bits, free_names, load, mapped, marked, mix, repeated_bitmap, shingle_sets, slices, staged, text_key, texts_of
from hazardloom.llm.components import components

WORDS = 5
PERCENT = 80
BYTES_PER_BIT = 16  # of the bitmap of repeated shingles
BITS = 26  # of the bitmap of shingles in several components
FRAGMENTS = 8
MINIMA = 12  # minimum hashes of a set
KEYS = 4  # those that classes meet by
AGREE = 6  # those that must agree before a pair is counted
SPARE = 20  # percent of a set looked at beyond the shortest prefix
BLOCK = 512  # classes of a block
BLOCK_SHINGLES = 1 << 20


def prefix_length(n: int, percent: int, spare: int) -> int:
    return n - -(-n * percent // 100) + max(1, n * spare // 100)


def least_hits(n: int, percent: int, spare: int) -> int:
    """Shingles that the prefixes of two linked sets share at least; the partner may be smaller by the threshold."""
    return max(1, n * spare * percent // 10_000)


def set_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, spare: int = SPARE, bits: int | None = None) -> DataFrame:
    """Per document: doc_id, fingerprints of the text (_k1, _k2) and of the set (f1, f2), n_shingles, and, where it may have a
    link, the set itself as an array of hashes and its minimum hashes, else nulls."""
    rows = texts_of(docs, *text_key(F.coalesce("text", F.lit(""))))
    bits = bits or bitmap_bits(rows, "text", BYTES_PER_BIT)

    def prefixes(whole):
        for b in slices(whole, "text"):
            sets = [s[: prefix_length(len(s), percent, spare)] for s in shingle_sets(b.column("text"), words)]
            yield np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    seen = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(rows.select("text"), prefixes, bits))
    names = ["doc_id", "_k1", "_k2", "n_shingles", "f1", "f2", "hashes", "minima"]
    salts = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
    turn = np.uint64(0x5851F42D4C957F2D)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                sizes, marks, held, minima = [], [], [], []
                for s in shingle_sets(b.column("text"), words):
                    first = s[: prefix_length(len(s), percent, spare)]
                    kept = len(s) and int(marked(seen.value, first, bits).sum()) >= least_hits(len(s), percent, spare)
                    sizes.append(len(s))
                    marks.append((int(np.bitwise_xor.reduce(mix(s))), int(mix(s * turn).sum(dtype=np.uint64))) if len(s) else (0, 0))
                    held.append(s.view(np.int64) if kept else None)
                    minima.append(np.array([mix(s ^ k).min() for k in salts]).view(np.int64) if kept else None)
                prints = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
                columns = [*(b.column(c) for c in names[:3]), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *[pa.array(x, pa.list_(pa.int64())) for x in (held, minima)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(rows, run, "doc_id long, _k1 long, _k2 long, n_shingles long, f1 long, f2 long, hashes array<long>, minima array<long>")


def fragment_of(shingle, fragments: int):
    """Cuts the order of hashes into equal ranges."""
    return F.shiftrightunsigned(shingle, 64 - (fragments.bit_length() - 1))


def segments_of(classes: DataFrame, fragments: int) -> DataFrame:
    """One row per class and fragment: cls, n, fragment, part (the shingles in it)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda f: F.struct(f.alias("fragment"), F.filter("hashes", lambda h: fragment_of(h, fragments).cast("int") == f).alias("part")))
    return classes.select("cls", "n", F.inline(cut)).where(F.size("part") > 0)


def verified(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: partial overlaps are counted in each fragment and summed."""
    left = segments.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    right = segments.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("fragment").alias("fragment_b"), F.col("part").alias("part_b"))
    both = pairs.join(left, "a").join(right, (pairs.b == right.b) & (F.col("fragment") == F.col("fragment_b"))).drop(right.b)
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("partial"))
    whole = partial.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("partial").alias("overlap"))
    return whole.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b", "overlap")


def length_fits(n_a, n_b, percent: int):
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Classes and the smallest class that has the same minimum under one of a few orders of the shingles, where
    enough of the other minima agree as well. Pairs passed over here are left to `cross_pairs`."""
    keys = F.posexplode(F.slice("minima", 1, KEYS)).alias("k", "value")
    rows = classes.select("cls", "n", "minima", keys)
    heads = rows.groupBy("k", "value").agg(F.min(F.struct("cls", "n", "minima")).alias("head"))
    agree = F.size(F.filter(F.zip_with("minima", "head.minima", lambda x, y: x == y), lambda same: same))
    pairs = rows.join(heads, ["k", "value"]).where(F.col("cls") != F.col("head.cls")).where(length_fits(F.col("n"), F.col("head.n"), percent) & (agree >= AGREE))
    return pairs.select(F.col("head.cls").alias("a"), F.col("cls").alias("b")).distinct()


def with_enough(classes: DataFrame, bitmap: np.ndarray, bits: int, percent: int) -> DataFrame:
    """Classes of which the threshold's share of shingles is marked."""
    sent = classes.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches):
        for b in batches:
            flat = b.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = pc.list_value_length(b.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
            hits = np.bincount(np.repeat(np.arange(len(sizes)), sizes), marked(sent.value, flat, bits), len(sizes))
            yield b.filter(pa.array(100 * hits >= percent * sizes))

    return classes.mapInArrow(keep, classes.schema)


def families(near: DataFrame, stars: DataFrame) -> DataFrame:
    """(cls, family): the smallest class that a class meets as head of a star, else itself."""
    heads = stars.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("head"))
    return near.select("cls").join(heads, "cls", "left").select("cls", F.least("cls", F.coalesce("head", "cls")).alias("family"))


def open_classes(classes: DataFrame, percent: int, bits: int) -> DataFrame:
    """Of classes (cls, n, component, family, hashes) those that may have a link to another component."""
    # a shingle counts once for each component that has it
    seen = classes.select("component", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    twice = lambda b: [np.repeat(b.column("h").to_numpy().view(np.uint64), 2)]
    shared = repeated_bitmap(seen.where("least <> most").select("h"), twice, bits)
    return with_enough(classes.select("cls", "n", "component", "family", "hashes"), shared, bits, percent)


def cross_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of open classes of different families and components that share one of their rarest shingles."""
    held = left.select("cls", "n", "component", "family", F.explode("hashes").alias("h"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("component", "family") for name, f in (("least", F.min), ("most", F.max))]
    known = held.groupBy("h").agg(F.count(F.lit(1)).alias("df"), *ends).where("least_component <> most_component and least_family <> most_family").select("h", "df")
    ranked = held.join(known, "h").groupBy("cls", "n", "component", "family").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    ranked = ranked.withColumn("common", F.size("order")).where(100 * F.col("common") >= percent * F.col("n"))
    shortest = F.col("common") - F.ceil(F.col("n") * percent / 100) + 1
    names = ["cls", "n", "component", "family", "common"]
    first = staged(ranked.select(*names, F.explode(F.slice("order", 1, shortest.cast("int"))).alias("x")).select(*names, "x.h"), "rare-shingles")
    other = first.select(*[F.col(c).alias(f"{c}_b") for c in names], "h")
    # an overlap is no larger than the shared shingles of either side, and the threshold asks for so many of both sizes
    reach = (100 + percent) * F.least("common", "common_b") >= percent * (F.col("n") + F.col("n_b"))
    apart = (F.col("cls") < F.col("cls_b")) & (F.col("component") != F.col("component_b")) & (F.col("family") != F.col("family_b"))
    met = first.join(other, "h").where(apart & length_fits(F.col("n"), F.col("n_b"), percent) & reach)
    return met.select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every set of a with every set of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (x, row), (y, col) = flat(a), flat(b)
    shared = np.intersect1d(x, y)
    if not len(shared):
        return out
    held = []
    for values, owner in ((x, row), (y, col)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        own = shared[at] == values
        order = np.argsort(at[own], kind="stable")
        held.append((owner[own][order], np.searchsorted(at[own][order], np.arange(len(shared) + 1))))
    (rows, row_at), (cols, col_at) = held
    df_a, df_b = np.diff(row_at), np.diff(col_at)
    # shingles that many pairs share are multiplied as dense columns, the others pair by pair
    hot = df_a * df_b * 64 > out.size
    dense = np.flatnonzero(hot)
    for n in range(0, len(dense), 4096):
        sides = []
        for owner, df, at, size in ((rows, df_a, row_at, len(a)), (cols, df_b, col_at, len(b))):
            part = dense[n : n + 4096]
            marks = np.zeros((size, len(part)), np.float32)
            marks[owner[_runs(at[part], df[part])], np.repeat(np.arange(len(part)), df[part])] = 1
            sides.append(marks)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    rest = np.flatnonzero(~hot)
    made = np.concatenate([[0], np.cumsum(df_a[rest] * df_b[rest])])
    cuts = [*np.unique(np.searchsorted(made, np.arange(0, made[-1], 1 << 21))).tolist(), len(rest)]
    for low, high in itertools.pairwise(cuts):
        part = rest[low:high]
        left = _runs(row_at[part], df_a[part])
        each = np.repeat(df_b[part], df_a[part])
        right = _runs(np.repeat(col_at[part], df_a[part]), each)
        out += np.bincount(np.repeat(rows[left], each) * len(b) + cols[right], minlength=out.size).reshape(out.shape)
    return out


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, end to end."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def in_blocks(members: DataFrame, group: str, block: int, block_shingles: int) -> DataFrame:
    """Classes (cls, n, hashes and others) dealt out so that every two of a group meet in one (large, home, i, j): groups of less
    than a block are dealt out together, larger ones block against block, where i and j are the blocks and `own` a class's."""
    enough = lambda count, shingles: F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(shingles) / block_shingles), F.lit(1))
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1").withColumn("blocks", enough("m", "total").cast("int"))
    buckets = sizes.where("blocks = 1").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).select(enough("m", "total")).first()[0]
    placed = members.select("cls", group).join(sizes, group).select("cls", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("own"))
    placed = members.join(placed, "cls")
    home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(int(buckets)))).otherwise(F.col(group))
    dealt = placed.select(*members.columns, "own", (F.col("blocks") > 1).alias("large"), home.alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("other"))
    return dealt.select(*members.columns, "own", "large", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def linked_in(table: pa.Table, group: str, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the two blocks of a table: their rows, and which of the first are linked with which of the second."""
    n, own, label = (table.column(c).to_numpy() for c in ("n", "own", group))
    hashes = table.column("hashes").combine_chunks()
    flat, ends = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64))
    # equal shingles of different groups are different
    sets = [s ^ k for s, k in zip(np.split(flat, ends[:-1]), mix(label.view(np.uint64)), strict=True)]
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)), bool)
    shared = overlaps([sets[k] for k in a], [sets[k] for k in b])
    linked = 100 * shared >= percent * (n[a][:, None] + n[b][None, :] - shared)
    if i == j:
        np.fill_diagonal(linked, False)
    return a, b, linked


def family_links(left: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): for every two components that are linked within a family, a link for each two blocks that hold one."""
    several = left.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("family")
    dealt = in_blocks(left.join(several, "family", "left_semi"), "family", block, block_shingles)

    def find(table: pa.Table) -> pa.Table:
        cls, component = (table.column(c).to_numpy() for c in ("cls", "component"))
        a, b, linked = linked_in(table, "family", percent)
        x, y = np.nonzero(linked & (component[a][:, None] != component[b][None, :]))
        x, y = a[x], b[y]
        ends = np.stack([np.minimum(component[x], component[y]), np.maximum(component[x], component[y])])
        _, first = np.unique(ends, axis=1, return_index=True)
        return pa.table({"a": cls[x[first]], "b": cls[y[first]]})

    return dealt.groupBy("large", "home", "i", "j").applyInArrow(find, "a long, b long")


def link_counts(members: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(cls, n_links) of classes (cls, n, component, hashes): the other classes of its component that a class is linked
    with."""
    dealt = in_blocks(members.select("cls", "n", "component", "hashes"), "component", block, block_shingles)

    def count(table: pa.Table) -> pa.Table:
        a, b, linked = linked_in(table, "component", percent)
        found = np.zeros(table.num_rows, np.int64)
        found[b] = linked.sum(0)
        found[a] = linked.sum(1)  # of one block twice the same
        return pa.table({"cls": table.column("cls"), "n_links": found})

    partial = dealt.groupBy("large", "home", "i", "j").applyInArrow(count, "cls long, n_links long")
    return partial.groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def linked_classes(sets: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (f1, f2, n, least, cls, component), and those that may have links (cls, n, component, hashes).

    cls is the class's smallest doc_id, or its fingerprint where no row has an id or another class has the same."""
    bits = bits or BITS
    open_sets = sets.where(F.col("hashes").isNotNull())
    classes = open_sets.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("least"), F.first("hashes").alias("hashes"), F.first("minima").alias("minima"))
    name = F.coalesce("least", "f1")
    shares = F.count(F.lit(1)).over(Window.partitionBy(name))
    cls = F.when(shares > 1, F.col("f1")).otherwise(name).alias("cls")
    classes = staged(classes.select("f1", "f2", "n", "least", cls, "hashes", "minima"), "classes")
    flat = lambda b: [b.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)]
    repeated = repeated_bitmap(classes.select("hashes"), flat, bits)
    near = staged(with_enough(classes.select("cls", "n", "hashes", "minima"), repeated, bits, percent), "near-classes")
    segments = staged(segments_of(near, fragments), "segments")
    stars = staged(star_pairs(near, percent), "stars")
    found = staged(verified(stars, segments, percent).select("a", "b"), "links")
    nodes = near.select(F.col("cls").alias("node"))
    grouped = components(nodes, found).withColumnRenamed("node", "cls")
    left = staged(open_classes(near.join(grouped, "cls").join(families(near, stars), "cls"), percent, bits), "open-classes")
    more = staged(family_links(left, percent).union(verified(cross_pairs(left, percent), segments, percent).select("a", "b")), "links")
    if not more.isEmpty():
        found = found.union(more)
        grouped = components(nodes, found).withColumnRenamed("node", "cls")
    labelled = classes.drop("hashes", "minima").join(grouped, "cls", "left")
    return labelled.withColumn("component", F.coalesce("component", "cls")), near.join(grouped, "cls").select("cls", "n", "component", "hashes")


def labelled_rows(docs: DataFrame, words: int, percent: int, bits: int | None, count: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a link (doc_id, _k1, _k2, n_shingles, least, component and, if asked for, n_links), and the others."""
    sets = staged(set_rows(docs, words, percent, bits=bits), "sets")
    classes, members = linked_classes(sets, percent, bits=bits)
    names = ["f1", "f2", F.col("n").alias("n_shingles"), "least", "component"]
    if count:
        classes = classes.join(link_counts(members, percent), "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        names.append("n_links")
    rows = sets.withColumn("open", F.col("hashes").isNotNull()).drop("hashes", "minima")
    return rows.where("open").drop("open").join(classes.select(*names), ["f1", "f2", "n_shingles"]), rows.where("not open")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int | None = None, count: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id (smallest id with the same set), component_id and, if asked for,
    n_links: how many other classes the class is linked with."""
    labelled, others = labelled_rows(docs, words, percent, bits, count)
    names = ["doc_id", "n_shingles", "class_id", "component_id"] + ["n_links"] * count
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    closed = others.select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return labelled.join(least, "component").withColumnRenamed("least", "class_id").select(*names).unionByName(closed.select(*names))


def op3(docs: DataFrame) -> DataFrame:
    return near_groups(docs)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """docs with one row of each group: the one with the smallest id, rows without an id last, then by a fingerprint of the text;
    of rows equal in id and text one. Rows whose set is empty stay. Columns may have any names."""
    labelled, _ = labelled_rows(docs, words, percent, bits, False)
    missing, number, k1, k2, keep, place = free_names(docs, 6)
    key = [missing, number, k1, k2]
    slim = labelled.select("component", F.col("doc_id").isNull().alias(missing), F.coalesce("doc_id", F.lit(0)).alias(number), F.col("_k1").alias(k1), F.col("_k2").alias(k2))
    first = slim.groupBy("component").agg(F.min(F.struct(*key)).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    marks = slim.distinct().join(first, "component").select(*key, (F.struct(*key) == F.col("first")).alias(keep))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col("doc_id").isNull().alias(missing), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(number), *[c.alias(n) for c, n in zip(text_key(text), (k1, k2), strict=True)]]
    keyed = docs.select("*", *own)
    # equal rows of a key stand together already, as the join has sorted them
    place_of = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    kept = keyed.join(marks.where(keep), key).withColumn(place, place_of).where(F.col(place) == 1)
    return keyed.join(marks, key, "left_anti").select(*docs.columns).union(kept.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(load(spark, sf_dir, "documents"))
