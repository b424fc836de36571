"""The rule ledger against counts of single documents."""

import random
from collections import Counter

from helpers import AWKWARD, documents, with_clashes

from hazardloom.llm import quality_rules as rules

BLANKS = " \t\n\x0b\x0c\r"


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    made = [prose(n) for n in (3, 49, 50, 60, 200)]
    made += ["a b c " * 40, "# $ % " * 30, "line one\n" * 9 + prose(60), "x y z " * 20 + prose(20), "w" * 900 + " " + prose(60), prose(60).upper(), "wow! " * 60, "12 34 56 " * 40 + "7", "! " * 60]
    return made + AWKWARD


def measured(text):
    words = [w for w in "".join(c if c not in BLANKS else " " for c in text or "").split(" ") if w]
    lines = [s for s in (text or "").split("\n") if s.strip(BLANKS)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def failing(m):
    out = {"few_words": m["n_words"] < 50, "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"], "symbols": m["n_symbols"] * 10 > m["n_words"]}
    return out | {"duplicate_lines": m["n_lines"] >= 4 and 10 * m["n_dup_lines"] > 3 * m["n_lines"], "short_words": 0 < m["n_words"] and m["word_chars"] < 2 * m["n_words"], "long_words": m["word_chars"] > 15 * m["n_words"]}


def test_measurements_bits_and_verdicts(spark):
    found = {r.doc_id: r for r in rules.op5(with_clashes(documents(spark, texts()))).collect()}
    assert len(found) == len(texts())
    names = [r.name for r in rules.RULES]
    for i, t in enumerate(texts()):
        row, want = found[i], measured(t)
        assert {k: row[k] for k in want} == want, (i, t and t[:50])
        failed = {n for k, n in enumerate(names) if row.failed_bits >> k & 1}
        assert {n for n, bad in failing(want).items() if bad} == failed & set(failing(want))
        assert row.base_failed == bool(failed & {"few_words", "repeated_windows"}) and row.kept == row.kept_v2 == (not failed)
        assert row.kept_base == (not row.base_failed) and row.kept_v1 == (not failed & set(rules.POLICIES[1].rules))
        assert row.only_rule == (next(iter(failed)) if len(failed) == 1 else None)
    bits = Counter(r.failed_bits for r in found.values())
    assert all(r.n_freed == (bits[r.failed_bits] if r.only_rule else None) for r in found.values()) and any(r.n_freed for r in found.values())


def test_ablations_are_plain_counts(spark):
    book = rules.ledger(documents(spark, texts())).cache()
    all_bits = [r.failed_bits for r in book.collect()]
    for policy in rules.POLICIES:
        whole = rules.mask(policy)
        got = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(book, policy).collect()}
        bit = {r.name: 1 << i for i, r in enumerate(rules.RULES)}
        assert got == {n: (sum(bool(b & bit[n]) for b in all_bits), sum(b & whole == bit[n] for b in all_bits)) for n in policy.rules}
        kept = rules.with_policies(book).where(f"kept_{policy.version}").count()
        for n in policy.rules:  # a rule's n_only is what dropping it brings back
            less = rules.Policy("less", tuple(x for x in policy.rules if x != n))
            assert rules.with_policies(book, (less,)).where("kept_less").count() == kept + got[n][1]
    row = rules.failing_any(book).first()
    some, every = 0, -1
    for b in all_bits:
        some, every = some | b, every & b
    assert (row.some, row.every) == (some, every)


def test_empty_table_equal_and_missing_ids(spark):
    empty = documents(spark, [])
    assert rules.op5(empty).collect() == []
    assert all((r.n_failed, r.n_only) == (0, 0) for r in rules.ablations(rules.ledger(empty), rules.BASE).collect())
    assert tuple(rules.failing_any(rules.ledger(empty)).first()) == (None, None)
    rows = rules.op5(documents(spark, ["a", "a", None], [5, 5, None])).collect()
    assert sorted(((r.doc_id, r.n_words) for r in rows), key=str) == [(5, 1), (5, 1), (None, 0)]
