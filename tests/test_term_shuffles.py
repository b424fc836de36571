"""Term weights of dealt texts: nothing is stored on the way and no term is shuffled by id."""

from hazardloom.operators import modelling
from hazardloom.plans import tables as tb


def test_terms_are_shuffled_for_the_vocabulary_alone(spark, capsys):
    docs = spark.createDataFrame([(1, "red fox red fox"), (2, "red hen"), (3, ""), (4, None)], "doc_id bigint, text string")
    weights = modelling.tfidf(docs.repartition(3, "doc_id"), "doc_id", "text", tb.ACCENTED, tb.PLAIN, 100)
    weights.explain()
    by_id = [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(doc_id" in x]
    assert by_id and all("REPARTITION_BY_NUM" in x for x in by_id)
    assert sorted((r.doc_id, r.term) for r in weights.collect()) == [(1, "fox"), (1, "fox red"), (1, "red"), (1, "red fox"), (2, "hen"), (2, "red"), (2, "red hen")]
