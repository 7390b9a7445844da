import numpy as np
from judge_jobs.llm import site_quality as sq
from test_site_quality import corpus


def test_repeated_ids_do_not_push_a_class_out(spark):
    """One bad id repeated beyond any bound leaves the weights as they are with one row of it."""
    rows, truth = corpus(60)
    hot = next(r for r in rows if not truth[r[0]])
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    frame = lambda x: spark.createDataFrame([r[:2] for r in x], "doc_id long, text string")
    once, often = sq.train(frame(rows), labels, rows=60), sq.train(frame(rows + [hot] * 200), labels, rows=60)
    assert np.allclose(once[0], often[0]) and np.isclose(once[1], often[1])
