"""The label model of toxicity sees every label, whatever the size of the classifier's sample."""

import numpy as np

from oddspark.llm import toxicity
from tests.llm.data import docs_of, labels_of, words


def test_all_labels_reach_the_label_model(spark):
    rows = [(i, words(40, i) + (" qworp" if i % 8 == 0 else ""), "en", "a", 0) for i in range(400)]
    marks = labels_of(spark, [(i, 1, int(i % 8 == 0)) for i in range(0, 400, 2)])
    few, all_ = ({r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows), marks, n).collect()} for n in (10, 20_000))
    # before, ten labels were too few to make the planted word a voter
    assert all(few[d].votes == all_[d].votes and abs(few[d].posterior - all_[d].posterior) < 1e-9 for d in all_)
    assert all((r.posterior > 0.5) == (d % 8 == 0) for d, r in few.items())


def test_unknown_documents_do_not_outweigh_few_labels(spark):
    # voter 1 marks the labelled toxic documents; a hundred times as many unknown ones fire voter 0 (a list) alone
    shape = "mask long, y int, n long"
    known = [(2, 1, 50), (0, 0, 400), (1, 0, 40)]
    size = lambda n: spark.createDataFrame([*known, (1, None, n)], shape)
    odds = [toxicity.fit_label_model(size(n), 2, 1).posterior(np.array([[1, 0]]))[0] for n in (4_900, 490_000)]
    assert abs(odds[0] - odds[1]) < 0.01
