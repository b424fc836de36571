"""Words and pairs of a text are made once, and counted per id."""

import re
from collections import Counter

from hazardloom.operators import modelling

TEXTS = [(1, "Aa bb aa, bb aa. x"), (2, None), (3, "x y"), (4, "one"), (5, "Été été 42 42 42 a_b"), (1, "aa zz"), (6, "")]


def test_terms_are_those_of_a_count_and_made_once(spark):
    df = spark.createDataFrame(TEXTS, "id long, t string")
    want = Counter()
    for i, t in TEXTS:
        w = re.findall(r"\b\w\w+\b", (t or "").lower().replace("é", "e"))
        want.update((i, x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    counts = modelling.term_counts(df, "id", "t", "é", "e")
    assert {(r.id, r.term): r.tf for r in counts.collect()} == dict(want) and counts.count() == len(want)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and len(re.findall(r"lambdafunction\(", plan)) == 1 and "element_at" not in plan
