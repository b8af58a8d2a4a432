import random

import numpy as np
from tessella.llm import quality
from tests.llm.data import DOC_SCHEMA, awkward_documents


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    says_bad = np.array([0.9, 0.6, 0.3, 0.8, 0.5])
    slips = np.array([0.02, 0.05, 0.01, 0.1, 0.03])
    votes = (rng.random((len(bad), 5)) < np.where(bad[:, None], says_bad, slips)).astype(int)
    votes[rng.random(votes.shape) < 0.1] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float), least_miss=0.0)
    assert abs(model.bad - 0.2) < 0.03
    assert np.abs(model.errs[:, 1, 1] - says_bad).max() < 0.06
    assert (model.good(votes) < 0.5).mean() > 0.1
    assert ((model.good(votes) < 0.5) == bad).mean() > 0.93


def test_the_shipped_prior_with_several_kinds_of_bad_texts():
    """Three labellers know the first kind and agree; two know the second, each a part of it. As shipped,
    more of the second kind is found than without the prior, and good texts are left alone."""
    rng = np.random.default_rng(2)
    for knows, least, free_most in ((0.9, 0.95, 0.9), (0.7, 0.45, 0.05)):
        kind = rng.choice(3, 20_000, p=[0.89, 0.06, 0.05])
        known = np.zeros((3, 6))
        known[1, :3], known[2, 3:5] = 0.98, knows
        says = np.where(rng.random((len(kind), 6)) < np.maximum(known[kind], 0.0003), quality.BAD, quality.GOOD)
        votes = np.where((says == quality.GOOD) & (rng.random(says.shape) < 0.3), quality.NONE, says)
        patterns, counts = np.unique(votes, axis=0, return_counts=True)
        found = lambda **o: quality.estimate(patterns, counts.astype(float), **o).good(votes) < 0.3  # noqa: B023, E731
        shipped, free = found(), found(least_miss=0.0)
        assert shipped[kind == 0].mean() < 0.01 and shipped[kind == 1].mean() > 0.99
        assert shipped[kind == 2].mean() > least and free[kind == 2].mean() < free_most


def test_accuracy_against_labels_that_it_never_sees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs).join(labels, "doc_id").collect()
    kept_good = np.mean([r.keep for r in rows if r.quality == 1])
    kept_bad = np.mean([r.keep for r in rows if r.quality == 0])
    assert kept_good > 0.99 and kept_bad < 0.05


def test_keep_good_returns_the_documents_that_score_keeps(spark):
    frame = awkward_documents(spark)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    wanted = quality.score(frame).where("keep").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in wanted)
    scores = {r.doc_id: r.score for r in quality.score(frame).collect()}
    assert scores[0] == scores[1] == scores[2] == 0


def test_vector_counts_repeats():
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "Cd", "X!!"]) for _ in range(50)).encode()
    some, values = quality.vector(text, text.lower().split(), quality.Shapes())
    assert list(some[:2]) == [0, 1] and len(some) == len(values) and values[1] > 0.8


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert quality.score(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_many_copies_leave_a_training_sample(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i in range(300) for t in texts], DOC_SCHEMA)
    once = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC_SCHEMA)
    many, few = quality.train(frame, train_rows=len(texts)), quality.train(once, train_rows=len(texts))
    assert many.weights.any()
    assert ((many.weights != 0) == (few.weights != 0)).all()


def test_twenty_thousand_rows_of_forty_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) BETWEEN 100 AND 2000").limit(40).collect()]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").crossJoin(spark.range(500)).drop("id")
    for rows in (40, 400, 4000):
        assert quality.train(frame, train_rows=rows).weights.any()
    kept = quality.score(frame).groupBy("keep").count().collect()
    assert sum(r["count"] for r in kept if r.keep) > 10_000


def test_shapes_cover_the_whole_word():
    assert "".join(quality.shape(b"Ab-" * 40)) == "Aa-" * 40
    ends = [b"a" * 100 + b"#$" * 3, b"a" * 100 + b"0A" * 3]
    one, other = (quality.vector(t, [t.lower()], quality.Shapes())[0].tolist() for t in ends)
    assert one != other
