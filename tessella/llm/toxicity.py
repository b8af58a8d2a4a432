"""Toxicity by a counterfactual-regularised classifier.

Features are the distinct words of a text and their beginnings. Labelled documents give each feature a
chi-squared score; the strongest go into a logistic model. For each labelled document that names a term
of a group, the term is swapped for each other term of the group, and the model pays for every change of
its score: ``fairness`` times the mean square. So a term that is frequent in toxic documents does not
make a neutral mention of it toxic.

Groups are a parameter (``IDENTITY``: terms for people, of several languages). The list cannot know the
words by which a corpus names groups, so more are found in the labelled documents themselves: words that
many clean documents hold as well as toxic ones (so naming them is neutral), of which those are taken
that a model would lean on most, by chi-squared; words that go together in texts are a group.

The model is fitted on ``train_rows`` labelled documents at most, in the order of a hash of doc_id, whose
texts are written once. Feature counts and term groups come from aggregates over them; to the driver go the
strongest features, and for each distinct example and swap the numbers of these features in it, so
rows and bytes are both bounded. All documents are scored, by a narrow pass over whole texts. The words
that a task has seen are remembered with the model's few features in them, up to a bound.

Cases: null and empty texts are scored by the intercept; labels without a document, and null labels,
teach nothing; without labelled documents of both kinds every score is the share of toxic ones (0.5
if there is none); repeated rows are scored one by one; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import first_by_hash, materialize, slices

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7)
#: Terms that are swapped for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "inmigrantes"),
)
#: Words longer than this are not remembered, and are no terms.
LONG = 64


def features(word: str) -> tuple[str, ...]:
    """Of a lower-cased word: itself and its beginnings."""
    return (f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    #: Terms, swaps, and the mean absolute change of the log odds by a swap, without and with the penalty.
    report: dict[str, float] = field(default_factory=dict)

    def scorer(self, most: int = 300_000):
        values = list(self.weights.values())
        number = {f: i for i, f in enumerate(self.weights)}
        seen: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in words_of(text):
                own = seen.get(word)
                if own is None:
                    own = tuple(number[f] for f in features(word) if f in number)
                    if len(seen) >= most:
                        seen.clear()
                    if len(word) <= LONG:
                        seen[word] = own
                if own:
                    found.update(own)
            margin = self.intercept + sum(values[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))

        return score


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n, toxic): documents with each feature, and toxic ones, of a part of a batch."""
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            n, toxic = Counter(), Counter()
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                own = {f for w in words_of(text) for f in features(w)}
                n.update(own)
                if label:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[f] for f in n], pa.int64())], names=["name", "n", "toxic"])


def _present(terms: Sequence[str]):
    """(terms): the numbers of the terms that a document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(number[w] for w in words_of(t) & number.keys()) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], names=["terms"])

    return run


def grouped(terms: Sequence[str], together: dict[tuple[int, int], int], size: int = 4) -> list[tuple[str, ...]]:
    """Terms, in their order, each with those of the rest that it is in one document with most often."""
    left, out = list(range(len(terms))), []
    while left:
        first = left.pop(0)
        near = sorted((i for i in left if together.get((first, i))), key=lambda i: -together[first, i])[: size - 1]
        left = [i for i in left if i not in near]
        if near:
            out.append(tuple(terms[i] for i in (first, *near)))
    return out


def differences(words: set[str], group_of: dict[str, Sequence[str]], number: dict[str, int]) -> Iterator[list[int]]:
    """For each swap of a term for another one of its group that the text lacks: the features that come
    (their numbers) and that go (-1 - number)."""
    terms = words & group_of.keys()
    if not terms:
        return
    held = Counter(number[f] for w in words for f in features(w) if f in number)
    for term in sorted(terms):
        own = {number[f] for f in features(term) if f in number}
        for other in group_of[term]:
            if other not in words:
                new = {number[f] for f in features(other) if f in number}
                yield sorted([f for f in new if not held[f]] + [-1 - f for f in own - new if held[f] == 1])


def _examples(names: Sequence[str], groups: Sequence[Sequence[str]]):
    """(label, numbers, n): examples as the numbers of their features; swaps, with label -1, as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(names)}
        group_of = {t: g for g in groups for t in g}
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                found: Counter = Counter()
                for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                    words = words_of(text)
                    found[label, tuple(sorted({number[f] for w in words for f in features(w) if f in number}))] += 1
                    found.update((-1, tuple(d)) for d in differences(words, group_of, number))
                yield pa.RecordBatch.from_arrays([pa.array([label for label, _ in found], pa.int32()), pa.array([np.array(x, np.int32).tobytes() for _, x in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["label", "numbers", "n"])

    return run


def fit(examples: Sequence[tuple[int, np.ndarray, int]], names: Sequence[str], *, ridge: float = 0.02, fairness: float = 1.0, compare: bool = False) -> Model:
    """The model of (label, feature numbers, count); label -1: the difference that a swap makes.
    ``compare``: also fit without the penalty, for the report."""
    real = [e for e in examples if e[0] >= 0]
    n = sum(e[2] for e in real)
    ones = sum(e[2] for e in real if e[0])
    if not 0 < ones < n:
        return Model({}, 0.0 if not n else 6.0 if ones else -6.0)
    width = len(names) + 1

    def dense(rows: Sequence[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(rows), width), np.float32)
        for i, (_, numbers, _) in enumerate(rows):
            come = numbers >= 0
            out[i, numbers[come]] = 1
            out[i, -1 - numbers[~come]] = -1
        return out, np.array([e[2] for e in rows], np.float32)

    x, count = dense(real)
    x[:, -1] = 1
    y = np.array([e[0] for e in real], np.float32)
    swaps = [e for e in examples if e[0] < 0]
    change, times = dense(swaps)
    penalty = np.full(width, ridge * np.sqrt(n))
    penalty[-1] = 1e-6
    paid = ((change.T * times) @ change).astype(np.float64) * (n / max(1.0, float(times.sum())))

    def solved(fairness: float) -> np.ndarray:
        fixed, w = np.diag(penalty) + fairness * paid, np.zeros(width)
        w[-1] = np.log(ones / (n - ones))
        for _ in range(30):
            guess = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
            slope = (count * guess * (1 - guess)).astype(np.float32)
            step = np.linalg.solve((x.T * slope) @ x + fixed, x.T @ (count * (y - guess)) - fixed @ w)
            w += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-4:
                break
        return w

    mean = lambda w: float((np.abs(change @ w.astype(np.float32)) * times).sum() / max(1.0, float(times.sum())))
    w = solved(fairness)
    report = {"swaps": float(times.sum()), "change": mean(w)} | ({"change_without": mean(solved(0.0))} if compare else {})
    return Model({f: float(w[j]) for j, f in enumerate(names) if abs(w[j]) > 1e-6}, float(w[-1]), report)


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = 6000, groups: Sequence[Sequence[str]] = IDENTITY, most_features: int = 1000, most_terms: int = 32, least_chi2: float = 14.0, **options) -> Model:
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labels")
    # At most train_rows small rows: the broadcast's size is bounded.
    sample = F.broadcast(first_by_hash(known, known.count(), train_rows, "doc_id"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", "text")
    rows = materialize(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < ones < n:
        return fit([(1, np.zeros(0, np.int32), ones), (0, np.zeros(0, np.int32), n - ones)], [])

    counts = rows.mapInArrow(_counts, "name string, n long, toxic long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    p, seen, toxic = ones / n, F.col("n"), F.col("toxic")
    spread = F.greatest(seen * p * (1 - p) * (1 - seen / (n + 1)), F.lit(1e-9))
    counts = materialize(counts.withColumn("chi2", (toxic - seen * p) * (toxic - seen * p) / spread), "counts")
    best = [F.col("chi2").desc(), "name"]
    names = [r.name for r in counts.where((seen >= 4) & (F.col("chi2") >= least_chi2)).orderBy(*best).limit(most_features).collect()]

    # Terms: of the given groups, and of those that many clean documents hold as well as toxic ones.
    listed = {t for g in groups for t in g}
    here = {r.name[1:] for r in counts.where(F.col("name").isin([f"={t}" for t in listed])).collect()}
    clean = n - ones
    neutral = (seen - toxic >= max(5, clean // 100)) & (toxic >= max(3, ones // 100)) & (toxic * clean <= 3 * ones * (seen - toxic))
    words = counts.where(F.startswith("name", F.lit("=")) & (F.length("name") <= LONG) & neutral).orderBy(*best).limit(most_terms)
    found = [r.name[1:] for r in words.collect() if r.name[1:] not in listed]
    each = rows.mapInArrow(_present(found), "terms array<int>").select(F.explode("terms").alias("a"), "terms").select("a", F.explode("terms").alias("b"))
    together = {(r.a, r.b): r["count"] for r in each.where("a <> b").groupBy("a", "b").count().collect()}
    groups = [*(g for g in groups if here & set(g)), *grouped(found, together)]
    terms = sorted({t for g in groups for t in g})
    names += [f for f in dict.fromkeys(f"={t}" for t in terms) if f not in set(names)]

    examples = rows.mapInArrow(_examples(names, groups), "label int, numbers binary, n long").groupBy("label", "numbers").agg(F.sum("n").alias("n")).orderBy("label", "numbers").collect()
    model = fit([(r.label, np.frombuffer(r.numbers, np.int32), r.n) for r in examples], names, **options)
    model.report["terms"] = float(len(terms))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([of(t) for t in batch["text"].to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, train_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; held-out labels are not learned."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), train_rows=train_rows)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
