"""Links and groups of shingle sets against all pairs."""

import random

from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import ngram_join


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(texts, ids=None):
    sets = [shingles(t) for t in texts]
    ids = list(range(len(texts))) if ids is None else ids
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    group = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            group[root(i)] = min(group.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(s), group.get(root(i))) for i, s in enumerate(sets)]


def planted(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    texts = []
    for size, changes in [(100, 1), (100, 4), (60, 2), (200, 9), (30, 1)]:
        base = prose(size)
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, changes)):
                copy[r.randrange(size)] = word()
            texts.append(" ".join(copy))
    passage = prose(40)
    texts += [" ".join([*passage, *prose(r.randint(0, 30))]) for _ in range(40)]
    chain = prose(80)
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 20)]
    return texts


def test_groups_are_those_of_all_pairs(spark):
    texts = [*planted(random.Random(3)), *AWKWARD, "Same Text HERE", "a b c d e", "a b c d e f", "A B\tC D\nE"]
    rows = ngram_join.op3(with_clashes(documents(spark, texts))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute(texts))


def test_small_bitmap_lets_more_through_but_loses_nothing(spark):
    texts = planted(random.Random(4))
    rows = ngram_join.near_groups(documents(spark, texts), bits=16).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute(texts))


def lone_classes(spark, texts, family):
    """Every different set as a component of its own."""
    from pyspark.sql import functions as F

    sets = ngram_join.set_rows(documents(spark, texts)).where("hashes is not null").dropDuplicates(["hashes"])
    return sets.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), F.col("doc_id").alias("component"), F.expr(family).cast("long").alias("family"), "hashes").cache()


def all_links(texts, kept):
    s = {i: shingles(texts[i]) for i in kept}
    return {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}


def test_links_between_families_are_found_in_full(spark):
    """Without the stars of step 2 and with families of one every link must come from the pairs of rare shingles."""
    texts = planted(random.Random(8))[:60]
    classes = lone_classes(spark, texts, "doc_id")
    left = ngram_join.open_classes(classes, 80, 26)
    got = {(r.a, r.b) for r in ngram_join.verified(ngram_join.cross_pairs(left, 80), ngram_join.segments_of(classes, 8)).collect()}
    want = all_links(texts, {r.cls for r in classes.collect()})
    assert got == want and len(want) > 50


def test_links_within_families_are_found_in_full(spark):
    """Families in one block and in many; between two families the pairs of rare shingles have the rest."""
    texts = planted(random.Random(9))
    for family, block in (("1", 1000), ("1", 16), ("doc_id % 3", 16)):
        classes = lone_classes(spark, texts, family)
        left = ngram_join.open_classes(classes, 80, 26)
        within = {(r.a, r.b) for r in ngram_join.family_links(left, block=block).collect()}
        across = {(r.a, r.b) for r in ngram_join.verified(ngram_join.cross_pairs(left, 80), ngram_join.segments_of(classes, 8)).collect()}
        want = all_links(texts, {r.cls for r in classes.collect()})
        assert {tuple(sorted(x)) for x in within} | across == want and (not across) == (family == "1")


def test_a_group_mostly_less_alike_than_the_threshold(spark):
    """Copies of one text that are linked with few of each other: components are exact, and no pairs are made for them."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(160)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for at in r.sample(range(160), r.randint(3, 7)):
            copy[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = ngram_join.near_groups(documents(spark, texts), count=False).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in rows) == sorted(brute(texts))
    assert 5 < len({x.component_id for x in rows}) < 90


def test_equal_and_missing_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts, ids = [base, base + " x", base, "other words entirely " * 9, None, base], [None, 9, 4, 4, 4, None]
    rows = ngram_join.op3(documents(spark, texts, ids)).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.n_shingles >= 56) == [(56, 4)] * 3 + [(57, 4)]


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    kept = ngram_join.one_of_each(documents(spark, [base, base + " x", "z", "", ""], [3, 2, 5, 6, 7]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]
    # two rows of an id are judged on their own, equal rows leave one, rows without an id come last
    texts = [base, base + " x", other, "clean text here", "clean text here", "", "", None, other + " y", base]
    ids = [1, 5, 5, 3, 3, 8, 8, None, None, None]
    table = with_clashes(documents(spark, texts, ids)).selectExpr("*", "1 as _gone", "2 as _own0", "3 as _OWN1", "4 as component", "5 as keep")
    rows = ngram_join.one_of_each(table)
    assert rows.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == sorted([(1, base), (5, other), (3, "clean text here"), (8, ""), (8, ""), (None, None)], key=str)
    lone = ngram_join.one_of_each(documents(spark, [base, base, base + " x"], [None, None, None])).collect()
    assert len(lone) == 1


def test_whole_table_query_and_empty_table(spark):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = ngram_join.query(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute(list(table.values()), list(table)))
    assert ngram_join.op3(documents(spark, [])).collect() == []


def link_brute(texts):
    """Per text, the different sets that its own is linked with."""
    sets = [shingles(t) for t in texts]
    distinct = set(sets)
    linked = {a: sum(a != b and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for b in distinct) for a in distinct}
    return [(i, linked[s]) for i, s in enumerate(sets)]


def test_every_link_is_counted(spark):
    texts = [*planted(random.Random(5)), *AWKWARD]
    want = link_brute(texts)
    rows = ngram_join.op3(with_clashes(documents(spark, texts))).collect()
    assert max(n for _, n in want) > 10
    assert sorted((r.doc_id, r.n_links) for r in rows) == want


def test_links_over_many_blocks(spark):
    texts = planted(random.Random(6))
    sets = ngram_join.set_rows(documents(spark, texts))
    _, members = ngram_join.linked_classes(sets)
    members = members.cache()
    want = dict(link_brute(texts))
    for block, shingles_ in ((4, 1 << 20), (1000, 300)):
        got = {r.cls: r.n_links for r in ngram_join.link_counts(members, block=block, block_shingles=shingles_).collect()}
        assert got and all(want[k] == v for k, v in got.items())
        assert {r.cls for r in members.collect() if want[r.cls]} <= set(got)
