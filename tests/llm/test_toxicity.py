import random

import numpy as np
from pyspark.sql import functions as F
from tessella.llm import toxicity
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents, words

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(rng, n=600):
    """Toxic texts often name one group; neutral ones seldom do."""
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        extra = (["idiot"] if rng.random() < 0.8 else ["scum"]) if bad else []
        extra += ["muslims"] if rng.random() < (0.7 if bad else 0.05) else []
        rows.append((i, words(rng, 8) + " " + " ".join(extra) + " " + words(rng, 8), int(bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, bad, "") for i, _, bad in rows], LABELS)


def test_swaps_lower_false_positives_on_neutral_mentions(spark):
    docs, labels = frames(spark, labelled(random.Random(2)))
    plain, fair = (toxicity.train(docs, labels, fairness=f) for f in (0.0, 5.0))
    assert fair.report["swaps"] > 100
    neutral, toxic = "the muslims of the town met today", "what an idiot he is"
    change = lambda score: abs(score(neutral) - score(neutral.replace("muslims", "christians")))
    plain, fair = plain.scorer(), fair.scorer()
    assert change(fair) < 0.3 * change(plain)
    assert fair(neutral) < plain(neutral)
    assert fair(toxic) > 0.5


def test_terms_that_no_list_names_are_found_and_swapped(spark):
    """Two invented names for groups: one often comes with insults, yet many clean texts hold it too."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.3
        own = (["idiot"] if bad else []) + (["zorbians"] if rng.random() < (0.6 if bad else 0.25) else []) + (["quellites"] if rng.random() < 0.3 else [])
        rows.append((i, words(rng, 8) + " " + " ".join(own) + " " + words(rng, 8), int(bad)))
    docs, labels = frames(spark, rows)
    model = toxicity.train(docs, labels, groups=(), compare=True)
    assert model.report["swaps"] > 200 and model.report["change"] < 0.3 * model.report["change_without"]
    free = toxicity.train(docs, labels, groups=(), fairness=0.0)
    lean = lambda m: abs(m.weights.get("=zorbians", 0.0) + m.weights.get("^zor", 0.0))
    assert lean(model) < 0.5 * lean(free)
    assert model.scorer()("the zorbians met") < free.scorer()("the zorbians met")


def test_swaps_are_made_in_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    report = toxicity.train(docs, labels, compare=True).report
    assert report["swaps"] > 500 and report["change"] < 0.2 * report["change_without"]


def test_differences_match_features_of_the_swapped_words():
    rng = random.Random(5)
    names = sorted({f for w in words(rng, 300).split() for f in toxicity.features(w)})
    number = {f: i for i, f in enumerate(names)}
    of = lambda ws: {number[f] for w in ws for f in toxicity.features(w) if f in number}
    for _ in range(50):
        own = toxicity.words_of(words(rng, 12))
        group = tuple({*rng.sample(sorted(own), 2), *toxicity.words_of(words(rng, 2))})
        got = [tuple(d) for d in toxicity.differences(own, {t: group for t in group}, number)]
        want = []
        for term in sorted(own & set(group)):
            for other in group:
                if other not in own:
                    new = of((own - {term}) | {other})
                    want.append(tuple(sorted([*(new - of(own)), *(-1 - f for f in of(own) - new)])))
        assert sorted(got) == sorted(want)


def test_fit_matches_plain_descent():
    """The penalised log loss of the fit is that of a plain gradient descent on the rows one by one."""
    rng = np.random.default_rng(3)
    x, y = (rng.random((80, 5)) < 0.4).astype(float), (rng.random(80) < 0.4).astype(int)
    examples = [(int(t), np.flatnonzero(r).astype(np.int32), 2) for t, r in zip(y, x)] + [(-1, np.array([1, -1 - 3], np.int32), 10)]
    model = toxicity.fit(examples, list("abcde"), ridge=0.05, fairness=0.7)
    w, n = np.zeros(6), 160
    ext, d = np.column_stack([x, np.ones(80)]), np.array([0, 1.0, 0, -1, 0, 0])
    ridge = np.array([0.05 * n**0.5] * 5 + [1e-6])
    for _ in range(40_000):
        slope = ext.T @ (2 * (y - 1 / (1 + np.exp(-ext @ w)))) - ridge * w - 0.7 * n * d * (d @ w)
        w += 0.005 * slope
    got = np.array([*(model.weights.get(c, 0.0) for c in "abcde"), model.intercept])
    assert np.abs(got - w).max() < 2e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.8
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.05


def test_labels_held_out_are_not_learned(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.judge(docs, x).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(5, 1, 1, ""), (6, 1, 0, ""), (8, 1, None, ""), (None, 1, 1, ""), (999, 1, 1, "")], LABELS)
    frame = awkward_documents(spark)
    out = toxicity.judge(frame, labels).collect()
    assert len(out) == frame.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.judge(spark.createDataFrame([], DOC_SCHEMA), labels).count() == 0
    none = toxicity.judge(frame, spark.createDataFrame([], LABELS)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
