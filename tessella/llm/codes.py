"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Vectors are cut into equal parts; each part position has a codebook, and a vector's code is the entry
nearest to each of its parts. A search holds the best entry so far and walks that entry's list of all
others, sorted by distance from it. A nearer entry is jumped to, and the walk goes on in its list;
entries that were seen are marked and not measured again. By the triangle inequality no entry is nearer
than the best one if it lies beyond twice the current distance from it, so the walk ends there. Lists
are walked for many vectors at a time, some places a step.

Codebooks start as the parts of some vectors and are refined by rounds of exact means: tasks add up the
parts of each entry, and the driver gets one sum for each entry and dimension. Codebooks and lists are
broadcast; their size is that of ``entries`` x (``entries`` + width), whatever the table. No vector is
shuffled. All arithmetic is on whole numbers: in 64-bit floats where they are exact, else Python's.

Cases: vectors that are null or hold null or non-finite components are dropped; shorter ones (empty
ones too) count as filled up with zeros, to the longest one's length, rounded up to whole parts; rows
with null vec_id take part and are the last to start an entry (of equal vec_ids the smaller vector is
first); repeated rows are rows of their own; with fewer rows than entries each row starts one; ties go
to the lower entry; an empty table gives an empty result, with empty codebooks; null labels are one
group; further columns are ignored. Components beyond 64 bits and errors are held at that range's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_counted, materialize
from tessella.llm.vectors import LARGEST, SUMS, Sums, as_lists, floor_means, held, largest, matrix, scaled, valid


@dataclass
class Codebooks:
    """``books[part][entry]``: whole numbers, as floats if ``exact`` floats hold every distance."""

    books: list[np.ndarray]
    width: int
    exact: bool

    @property
    def kind(self) -> type:
        return np.float64 if self.exact else object

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.reshape(-1)).encode()).hexdigest()


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) if a.dtype == object else np.einsum("ij,ij->i", a, b)


class Orchard:
    """The entries of one codebook, with every entry's list of all entries by distance."""

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.square = book, _dot(book, book)
        gaps = np.stack([((book - entry) ** 2).sum(1) for entry in book])
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, 1)
        self.measured = 0

    def nearest(self, x: np.ndarray, stride: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """The entry nearest to each row of ``x`` (the lower one of equals) and its squared distance."""
        n, size = len(x), len(self.book)
        square = _dot(x, x)
        best, far = np.zeros(n, np.int64), square - 2 * (x @ self.book[0]) + self.square[0]
        seen = np.zeros((n, size), bool)
        seen[:, 0] = True
        at, left = np.zeros(n, np.int64), np.arange(n)
        self.measured += n
        while len(left):
            own, places = best[left], at[left][:, None] + np.arange(stride)
            inside = places < size
            places = np.minimum(places, size - 1)
            entry = self.lists[own[:, None], places]
            near = inside & (self.gaps[own[:, None], places] <= 4 * far[left][:, None])
            row, place = np.nonzero(near & ~seen[left[:, None], entry])
            vector, to = left[row], entry[row, place]
            seen[vector, to] = True
            self.measured += len(row)
            found = np.full(entry.shape, np.inf, x.dtype)
            found[row, place] = square[vector] - 2 * _dot(x[vector], self.book[to]) + self.square[to]
            least = found.min(1)
            who = np.where(found == least[:, None], entry, size).min(1)
            jump = (least < far[left]) | ((least == far[left]) & (who < own))
            best[left[jump]], far[left[jump]] = who[jump], least[jump]
            at[left] = np.where(jump, 0, at[left] + stride)
            left = left[jump | near[:, -1]]
        return best, far


def _parts(v: np.ndarray, books: Codebooks) -> list[np.ndarray]:
    size = books.width // len(books.books)
    return [v[:, p * size : (p + 1) * size].astype(books.kind) for p in range(len(books.books))]


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, finders = shared.value
        sums = [Sums(len(b), b.shape[1], np.int64 if books.exact else object) for b in books.books]
        for batch in batches:
            for finder, x, own in zip(finders, _parts(matrix(batch["v"], books.width), books), sums):
                own.add(finder.nearest(x)[0], x)
        for p, own in enumerate(sums):
            yield own.batch(part=p)

    return run


def integers(vectors: DataFrame, vector: str = "embedding", label: str = "label", scale: int = 1024) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, as a written table."""
    base = vectors.where(valid(F.col(vector))).select("vec_id", F.col(label).alias("label"), scaled(F.col(vector), scale).alias("v"))
    return materialize(base, "vectors")


def train(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of ``integers``' rows."""
    spark = vectors.sparkSession
    _, longest, top = largest(vectors)
    width = max(1, -(-longest // parts)) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), width), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row.v)] = row.v
    exact = 4 * (width // parts) * (2 * top) ** 2 < 2**53
    books = Codebooks(np.split(start.astype(np.float64 if exact else object), parts, axis=1), width, exact)
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast((books, [Orchard(b) for b in books.books]))
        new = [b.copy() for b in books.books]
        for part, entry, dim, mean in floor_means(vectors.mapInArrow(_sums(shared), "part int, " + SUMS), "part"):
            new[part][entry, dim] = mean
        books = Codebooks(new, width, exact)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, codes array<int>, error) of ``integers``' rows; error: squared distances, summed over parts."""
    shared = vectors.sparkSession.sparkContext.broadcast((books, [Orchard(b) for b in books.books if len(b)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, finders = shared.value
        for batch in batches:
            if batch.num_rows:
                found = [f.nearest(x) for f, x in zip(finders, _parts(matrix(batch["v"], books.width), books))]
                codes = as_lists(np.stack([c for c, _ in found], 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], codes, held(sum(d for _, d in found))], names=["vec_id", "label", "codes", "error"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with the vector ``approximate`` that each code stands for."""
    shared = coded.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", approximate array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = matrix(batch["codes"], len(shared.value.books))
                v = np.concatenate([b[codes[:, p]] for p, b in enumerate(shared.value.books)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(v.astype(np.int64))], names=[*batch.schema.names, "approximate"])

    return coded.mapInArrow(run, schema)


def report(vectors: DataFrame, *, vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label): the code in hexadecimal digits, two for each part
    where 256 entries are the most; a label may hold any share of the rows."""
    base = integers(vectors, vector, label, scale)
    books = train(base, parts=parts, entries=entries, rounds=rounds)
    digits = 2 * max(1, -(-(entries - 1).bit_length() // 8))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
    none, key = F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(base.schema["label"].dataType)).alias("key")
    coded = materialize(encode(base, books).select("vec_id", "label", code.alias("code"), "error", none, key), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = materialize(coded.groupBy("none", "key").agg(total.alias("label_error"), F.count("*").alias("n")), "labels")
    out = join_counted(coded, labels, ["none", "key"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "label")
