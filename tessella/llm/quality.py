"""Quality classifier by weak labels.

Nine heuristic labellers vote on each document: good, bad, or no vote. Expectation-maximisation
estimates how each of them errs when it votes (no vote says nothing), from the counts of all vote
patterns of the whole corpus (there are 3**9 at most, so the counts are small whatever the corpus), and
gives each pattern its probability of being good. With those as soft labels a logistic model over hashed
token shapes is fitted, on the ``train_rows`` distinct texts that come first in the order of a hash; it
scores every document.

The estimation has one prior: ``least_miss``. Bad texts are bad in several ways and each labeller knows
some of them, so none is believed to find more than a share of 1 - least_miss. Without it, labellers
that look at one kind of fault agree with each other so well that this kind alone becomes the bad class
and good votes on the other kinds outvote those that know them.

The texts are read three times: for votes and hashes (written as 12 bytes a document), for the sample,
and for the scores.

Cases: null and empty texts, and texts without words, have score 0 and are rejected; very long texts
are judged whole; repeated rows are judged one by one (and count in the statistics); null doc_ids
take part; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import first_by_hash, materialize, renamed, slices, text_bytes

GOOD, BAD, NONE = 0, 1, 2
LABELLERS = 9
WIDTH = 1 << 14
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|!~^<>{}="
SPACES, NOT_LETTERS = b" \t\n\r\x0b\x0c", bytes(c for c in range(128) if not chr(c).isalpha())
MARK_RUN = re.compile(rb"[#$%&*|!~^<>{}=]+")


def by(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from the other on."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Of the labellers, in fixed order; ``words`` are those of the lower-cased text."""
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x]
    counts = Counter(words)
    return (
        by((size - len(text.translate(None, MARKS))) / size, 0.006, 0.03),
        by((size - len(text.translate(None, UPPER))) / size, 0.15, 0.3),
        by(sum(map(operator.eq, words, words[1:])) / n, 0.04, 0.15) if n >= 4 else NONE,
        by(1 - len(counts) / n, 0.6, 0.75) if n >= 20 else NONE,
        by(text.count(b"|") / max(1, n), 0.01, 0.1),
        by(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 4 else NONE,
        by(max(counts.values()) / n, 0.15, 0.3) if n >= 20 else NONE,
        by(len(MARK_RUN.findall(text)) / max(1, n), 0.03, 0.2),
        by(1 - len(text.translate(None, NOT_LETTERS)) / max(1, len(text.translate(None, SPACES))), 0.1, 0.2) if n >= 4 else NONE,
    )


def shape(word: bytes) -> list[str]:
    """Runs of capitals, letters and digits become one sign each; marks stay. Six signs are a shape:
    a longer word has several, up to its end."""
    out = []
    for c in word.decode("utf-8", "replace"):
        sign = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not (out and out[-1] == sign and sign in "Aa0"):
            out.append(sign)
    return ["".join(out[i : i + 6]) for i in range(0, len(out), 6)]


class Shapes(dict):
    """Numbers of token shapes by token, remembered up to a bound."""

    def __missing__(self, word: bytes) -> list[int]:
        n = [2 + crc32(x.encode()) % (WIDTH // 2 - 2) for x in shape(word)]
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = n
        return n


def vector(text: bytes, words: list[bytes], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: square roots of the shares of token shapes and of pairs of them;
    feature 0: tokens equal to the one before, 1: share of repeated words."""
    own = np.fromiter(chain.from_iterable(map(shapes.__getitem__, text.split())), np.int64)
    pairs = WIDTH // 2 + (own[:-1] * 31 + own[1:]) % (WIDTH // 2)
    n = max(1, len(words))
    same = sum(map(operator.eq, words, words[1:]))
    some, counts = np.unique(np.concatenate([own, pairs]), return_counts=True)
    values = np.sqrt(np.concatenate([[same / n, 1 - len(set(words)) / n], counts / max(1, len(own))]))
    return np.concatenate([[0, 1], some]).astype(np.int32), values.astype(np.float32)


@dataclass
class WeakLabels:
    """P(bad), and for each labeller the probabilities of its two votes for good and bad texts."""

    bad: float
    errs: np.ndarray

    def good(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that texts with these votes (one row each) are good."""
        logs = np.log(np.maximum(self.errs, 1e-9))
        logs = np.concatenate([logs, np.zeros((*logs.shape[:2], 1))], axis=2)  # no vote
        per = [np.log(max(1e-9, p)) + sum(logs[j, c][patterns[:, j]] for j in range(patterns.shape[1])) for c, p in ((0, 1 - self.bad), (1, self.bad))]
        return 1 / (1 + np.exp(np.clip(per[1] - per[0], -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100, least_miss: float = 0.5) -> WeakLabels:
    """Expectation-maximisation over counted vote patterns. It starts from labellers that seldom
    call a good text bad, and each is held to miss ``least_miss`` of the bad texts at least."""
    m = patterns.shape[1]
    model = WeakLabels(0.15, np.tile(np.array([[0.99, 0.01], [max(0.5, least_miss), 1 - max(0.5, least_miss)]]), (m, 1, 1)))
    for _ in range(rounds):
        good = model.good(patterns)
        weight = np.stack([good * counts, (1 - good) * counts])
        errs = np.stack([[[weight[c][patterns[:, j] == v].sum() + 0.01 for v in (GOOD, BAD)] for c in range(2)] for j in range(m)])
        bad = weight[1].sum() / max(1e-9, weight.sum())
        moved = abs(bad - model.bad)
        errs = errs / errs.sum(2, keepdims=True)
        errs[:, 1, GOOD] = np.maximum(errs[:, 1, GOOD], least_miss)
        errs[:, 1, BAD] = 1 - errs[:, 1, GOOD]
        model = WeakLabels(float(bad), errs)
        if moved < 1e-9:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    intercept: float

    def of(self, text: bytes, words: list[bytes], shapes: Shapes) -> float:
        if not words:
            return 0.0
        some, values = vector(text, words, shapes)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + float((self.weights[some] * values).sum()), -50, 50))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], *, ridge: float = 1e-4, least: int = 3, most: int = 1500) -> Scorer:
    """A logistic model of (feature numbers, values, soft label)."""
    weights = np.zeros(WIDTH, np.float32)
    y = np.array([r[2] for r in rows])
    if not len(y):
        return Scorer(weights, 0.0)
    seen = np.bincount(np.concatenate([r[0] for r in rows]), minlength=WIDTH)
    chosen = [i for i in np.argsort(-seen, kind="stable")[:most].tolist() if seen[i] >= min(least, len(y))]
    place = np.full(WIDTH, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen) + 1), np.float32)
    for i, (some, values, _) in enumerate(rows):
        at = place[some]
        x[i, at[at >= 0]] = values[at >= 0]
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 1e-6 * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        step = np.linalg.solve((x.T * slope) @ x + np.diag(penalty), x.T @ (y - p).astype(np.float32) - penalty * w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    weights[chosen] = w[:-1]
    return Scorer(weights, float(w[-1]))


PLACES = 3 ** np.arange(LABELLERS)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each text with words, and its votes as one number."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            found = [votes(t, w) if (w := t.lower().split()) else None for t in text_bytes(batch["text"])]
            held = np.array([v is not None for v in found], bool)
            codes = np.array([v for v in found if v is not None], np.int64).reshape(-1, LABELLERS) @ PLACES
            yield pa.RecordBatch.from_arrays([batch["h"].filter(pa.array(held)), pa.array(codes.astype(np.int32))], names=["h", "code"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            rows = [(list(votes(t, w)), *vector(t, w, shapes)) for t in text_bytes(batch["text"]) if (w := t.lower().split())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["pattern", "some", "values"])


def train(docs: DataFrame, *, train_rows: int = 4000) -> Scorer:
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    found = materialize(texts.mapInArrow(_votes, "h long, code int"), "votes")
    counted = found.groupBy("code").count().orderBy("code").collect()
    if not counted:
        return Scorer(np.zeros(WIDTH, np.float32), 0.0)
    patterns = np.array([r.code for r in counted])[:, None] // PLACES % 3
    weak = estimate(patterns, np.array([r["count"] for r in counted], np.float64))
    # Distinct texts up to the train_rows-th hash; the hashes come first, without the texts.
    distinct = materialize(found.select("h").distinct(), "hashes")
    hashes = first_by_hash(distinct, distinct.count(), train_rows, "h")
    last = hashes.agg(F.max(F.xxhash64("h"))).first()[0]
    sample = texts.where(F.xxhash64("h") <= last).dropDuplicates(["h"]).select("text")
    rows = sample.mapInArrow(_vectors, "pattern array<int>, some binary, values binary").collect()
    if not rows:
        return Scorer(np.zeros(WIDTH, np.float32), 0.0)
    good = weak.good(np.array([r.pattern for r in rows]))
    return fit([(np.frombuffer(r.some, np.int32), np.frombuffer(r["values"], np.float32), g) for r, g in zip(rows, good.tolist())])


def _scored(model, kept: list[str], least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, shapes = model.value, Shapes()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                scores = pa.array([scorer.of(t, t.lower().split(), shapes) for t in text_bytes(batch["text"])], pa.float64())
                out = pa.RecordBatch.from_arrays([*(batch[c] for c in kept), scores], names=[*kept, "score"])
                yield out if least is None else out.filter(pc.greater_equal(scores, least))

    return run


def score(docs: DataFrame, *, threshold: float = 0.3, train_rows: int = 4000) -> DataFrame:
    """(doc_id, score, keep) for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_rows=train_rows))
    out = docs.select("doc_id", "text").mapInArrow(_scored(model, ["doc_id"], None), "doc_id long, score double")
    return out.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, *, threshold: float = 0.3, train_rows: int = 4000) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_rows=train_rows))
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = renamed(docs, own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(_scored(model, rows.columns, threshold), f"{schema}, score double")
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
