"""Matches against all windows and items: nothing false, and the target recall."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, SF, documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardloom.llm import decontamination as dc

ITEMS = "item_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def any_end(words, own):
    """Fewest edits of the item over all windows, of any length."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(own, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(texts, items, percent=20, least=8):
    """Fewest edits over all windows; a text without enough of the item's words has none within the limit."""
    out = {}
    for d, text in enumerate(texts):
        words = (text or "").lower().split()
        held = Counter(words)
        for i, item in items:
            own = (item or "").lower().split()
            k = len(own) * percent // 100
            if len(own) < least or sum((Counter(own) & held).values()) < len(own) - k:
                continue
            near = any_end(words, own)
            if near <= k:
                out[d, i] = near
    return out


def changed(r, words, edits, word):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = word()
        elif kind == 1 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, word())
    return words


def test_recall_and_no_false_match(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(8, 45)))) for i in range(14)] + [(100, None), (101, ""), (102, "too short"), (None, " ".join(prose(20)))]
    texts = []
    for i, t in items[:14]:
        n = len(t.split())
        for edits in (0, 0, 1, n // 10, n // 5):
            texts.append(" ".join([*prose(r.randint(0, 20)), *changed(r, t.split(), edits, word), *prose(r.randint(0, 20))]))
    texts += [" ".join(prose(60)) for _ in range(10)]
    rows = dc.op6(with_clashes(documents(spark, texts)), spark.createDataFrame(items, ITEMS)).collect()
    got, want = {(x.doc_id, x.item_id): x.edits for x in rows}, brute(texts, items[:14])
    assert set(got) <= set(want) and len(got) == len(rows)
    assert all(got[k] >= want[k] for k in got)
    assert all(k in got and got[k] == 0 for k, v in want.items() if v == 0)
    assert len(got) >= 0.95 * len(want), (len(got), len(want))


def test_case_and_blanks_and_short_documents(spark):
    item = "One two three four five six seven eight nine ten"
    texts = [item.upper().replace(" ", "\n"), "x " + item, " ".join(item.split()[:9]), " ".join(item.split()[:7]), *AWKWARD]
    rows = dc.op6(documents(spark, texts), spark.createDataFrame([(1, item), (1, item)], ITEMS)).collect()
    assert sorted((x.doc_id, x.edits) for x in rows) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 1), (2, 1)]
    kept = dc.clean(with_clashes(documents(spark, texts)), spark.createDataFrame([(1, item)], ITEMS))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(3, len(texts)))


def test_blocks_give_the_same(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, dc.matches(docs, items).collect()))
    assert one == sorted(map(tuple, dc.matches(docs, items, block_bytes=2000).collect()))
    texts = {x.doc_id: " ".join((x.text or "").lower().split()) for x in docs.collect()}
    exact = {(d, i.item_id) for d, t in texts.items() for i in items.collect() if f" {' '.join(i.text.lower().split())} " in f" {t} "}
    assert exact and exact <= {(a, b) for a, b, *_ in one}


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c d e f g h i")], ITEMS)
    assert dc.op6(documents(spark, []), some).collect() == []
    assert dc.op6(documents(spark, ["a b c d e f g h i"]), spark.createDataFrame([], ITEMS)).collect() == []
    assert dc.clean(documents(spark, ["a"]), spark.createDataFrame([], ITEMS)).count() == 1


def test_words_put_in_or_left_out_cost_one_edit_each(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items, texts = [], []
    for i, n in enumerate([16] * 6 + [40] * 6):
        own = [word() for _ in range(n)]
        items.append((i, " ".join(own)))
        k = n // 5 * 5 // 8 + 1  # 2 of the 3, 6 of the 8 that are allowed
        more = [*own[: n // 2], *[word() for _ in range(k)], *own[n // 2 :]]
        less = [*own[: n // 2], *own[n // 2 + k :]]
        for changed_ in (more, less):
            texts.append(" ".join([*[word() for _ in range(12)], *changed_, *[word() for _ in range(12)]]))
    want = {(d, i): e for d, t in enumerate(texts) for i, x in items if (e := any_end(t.split(), x.split())) <= len(x.split()) // 5}
    rows = dc.op6(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    got = {(x.doc_id, x.item_id): x.edits for x in rows}
    assert len(want) == 24 and set(got) <= set(want) and len(got) >= 0.95 * len(want), (len(got), len(want))
    assert all(got[k] >= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    kept = dc.clean(documents(spark, texts), spark.createDataFrame(items, ITEMS))
    assert kept.count() == len(texts) - len({d for d, _ in got})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_closest_window(text, item):
    mask = {w: sum(1 << n for n, x in enumerate(item) if x == w) for w in set(item)}
    edits, end = dc.closest_end(text, mask, len(item))
    each = {(a, b): distance(text[a:b], item) for a in range(len(text) + 1) for b in range(a, len(text) + 1)}
    assert edits == min(each.values()) == any_end(text, item)
    begin = dc.window_begin(text[:end], item, edits)
    assert each[begin, end] == edits and end == min([b for (a, b), e in each.items() if e == edits] if edits < len(item) else [0])


def words_of(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def search(items, texts):
    index = dc.Index(list(range(len(items))), [" ".join(x) for x in items], dc.Rules())
    return index.search(*dc.word_hashes(pa.array([" ".join(t) for t in texts])))


@pytest.mark.parametrize("size", [8, 16, 30, 33, 59, 100, 200, 400])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_recall_at_the_edit_limit(size, kind):
    """Every kind of edit on its own, as many as are allowed."""
    r, g = random.Random(size * 3 + kind), np.random.Generator(np.random.PCG64(size * 3 + kind))
    items = [words_of(r, size) for _ in range(60)]
    texts = []
    for item in items:
        k, own = size // 5, list(item)
        spots = sorted(g.choice(size, k, replace=False).tolist(), reverse=True)
        for at in spots:
            if kind == 2:
                del own[at]
            else:
                own[at : at + (kind == 0)] = words_of(r, 1)
        texts.append([*words_of(r, 15), *own, *words_of(r, 15)])
    found = search(items, texts)
    assert set(found) <= {(i, i) for i in range(60)} and all(e == any_end(texts[d], items[i]) for (d, i), (e, _) in list(found.items())[:10])
    assert len(found) >= 0.95 * 60, len(found)


def test_many_items_with_one_opening():
    """Items that begin alike cost no more than their candidates' words."""
    r = random.Random(5)
    opening = ["which", "of", "the", "following"]
    items = [opening + words_of(r, 20) for _ in range(4000)]
    text = [w for _ in range(100) for w in opening + words_of(r, 5)] + items[7]
    search(items[:3], [text[:50]])
    index = dc.Index(list(range(len(items))), [" ".join(x) for x in items], dc.Rules())
    hashes = dc.word_hashes(pa.array([" ".join(text)]))
    began = time.process_time()
    found = index.search(*hashes)
    assert found == {(0, 7): (0, len(text) - 24)} and time.process_time() - began < 15


def test_clean_over_several_blocks_with_clashing_names(spark):
    r = random.Random(8)
    items = [words_of(r, 20) for _ in range(6)]
    texts = [" ".join(words_of(r, 5) + x) for x in items] + [" ".join(words_of(r, 30)) for _ in range(4)] + [None, ""]
    docs = with_clashes(documents(spark, texts)).selectExpr("*", "1 as _own0", "2 as _OWN1", "3 as _k2")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)
    for size in (200, 1 << 20):
        kept = dc.clean(docs, table, block_bytes=size)
        assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == list(range(6, 12))
