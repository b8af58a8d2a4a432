"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits (lower-cased) and of all bytes above 127, so every
language keeps its letters. Windows of ``n`` words of each benchmark item are held by a broadcast
index: the items' word numbers in one array, and the windows' rolling hashes, sorted, with the place
of each. Documents are scanned once, and every hit is verified word by word.

The index is dealt into blocks by its own size: ``WORD_BYTES`` a word is its bound, words all different
included, and a block has as many words as fit ``block_bytes``. Items are cut into pieces that overlap
by n - 1 words, so one long item is no larger block. The documents are scanned once per block.

Cases: null or empty texts have no words; an item with fewer than ``n`` words (but not none) is one
window; an item without words matches nothing; equal items are all named; an empty benchmark leaves
every document clean; rows with a repeated doc_id are judged one by one; null item_ids are not
named; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, renamed, slices, text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
RESULTS = ["n_words", "n_hit", "items", "spans"]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of the index a word, at most: its number, its window's hash, place and piece, and a word of
#: up to 100 bytes in the dictionary. And bytes of a block's index.
WORD_BYTES = 4 + 16 + 240
BLOCK_BYTES = 192 << 20


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class NgramIndex:
    """Windows of ``n`` words of benchmark pieces (item_id, words); a piece of fewer words, but not
    none, is one window."""

    def __init__(self, pieces: list[tuple[object, list[bytes]]], n: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names = [None if item_id is None else str(item_id) for item_id, _ in pieces]
        sizes = np.array([len(words) for _, words in pieces], np.int64)
        self.ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for _, words in pieces for w in words), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        #: By length: hashes in order, and for each the place of its window and its piece.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {min(n, int(s)) for s in sizes} - {0}:
            own = np.flatnonzero(sizes == size) if size < n else np.flatnonzero(sizes >= n)
            many = sizes[own] - size + 1
            piece = np.repeat(own, many)
            at = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
            hashes = hash_windows(self.ids, at, size)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], at[order].astype(np.int32), piece[order].astype(np.int32)

    def size(self) -> int:
        """Bytes held, words counted as Python's dictionary holds them."""
        arrays = [self.ids, *(a for w in self.windows.values() for a in w)]
        return sum(a.nbytes for a in arrays) + sum(100 + sys.getsizeof(w) for w in self.numbers)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Windows of ``words`` that are in the index, as (start, end), and the items they are of."""
        ids = np.fromiter((self.numbers.get(w, 0) for w in words), np.int32, len(words))
        spans, items = [], set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, (hashes, at, piece) in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            wanted = hash_windows(ids, starts, size)
            low = np.searchsorted(hashes, wanted)
            found = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == wanted)
            high = np.searchsorted(hashes, wanted[found], side="right")
            seen: set[bytes] = set()
            for s, a, b in zip(starts[found].tolist(), low[found].tolist(), high.tolist()):
                window = ids[s : s + size]
                if (key := window.tobytes()) in seen:
                    spans.append((s, s + size))
                    continue
                equal = (self.ids[at[a:b, None] + np.arange(size)] == window).all(1)
                if equal.any():
                    seen.add(key)
                    spans.append((s, s + size))
                    items |= {self.names[i] for i in piece[a:b][equal].tolist()}
        return spans, items - {None}


def hash_windows(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h, by = np.zeros(len(starts), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        h = h * by + ids[starts + j].astype(np.uint64)
    return h


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, n: int, most: int) -> DataFrame:
    """(item_id, words, part): the items' words in pieces of ``most`` windows at most."""
    words = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = benchmark.select("item_id", words.alias("words")).where(F.size("words") > 0)
    last = F.floor((F.greatest(F.size("words") - n + 1, F.lit(1)) - 1) / most).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("item_id", F.slice("words", F.col("part") * most + 1, F.lit(most + n - 1)).alias("words"), "part")


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns named in ``keep``, then FOUND.

    ``items``: ids, as strings, of the benchmark items with a window in the document, sorted;
    ``spans``: maximal runs of hit words, as word numbers. Each block's pass adds to what the passes
    before it have found in the same row, so nothing is shuffled; between blocks the rows are
    written, so that only one block's index is in memory."""
    most = max(n, block_bytes // WORD_BYTES)
    pieces = _pieces(benchmark, n, max(n, most // 16))
    blocks = max(1, -(-int(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // most))
    block = F.pmod(F.xxhash64("item_id", "words", "part"), F.lit(blocks))
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (docs.select(*keep).schema if keep else []))
    rows = docs.select(*keep, "doc_id", "text")
    for k in range(blocks):
        # About ``most`` words, whatever the benchmark's size.
        own = [(r.item_id, [w.encode() for w in r.words]) for r in pieces.where(block == k).select("item_id", "words").collect()]
        index = docs.sparkSession.sparkContext.broadcast(NgramIndex(own, n))
        rows = (rows if k == 0 else materialize(rows, "decontam")).mapInArrow(_scanner(index), kept + FOUND)
    return rows


def _scanner(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = index.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                earlier = batch.to_pydict() if "spans" in batch.schema.names else None
                base = batch.select([c for c in batch.schema.names if c not in RESULTS])
                n_words, n_hit, items, spans = [], [], [], []
                for i, text in enumerate(text_bytes(batch["text"])):
                    words = words_of(text)
                    found, named = ngrams.hits(words)
                    if earlier:
                        found += [(r["start"], r["end"]) for r in earlier["spans"][i]]
                        named |= set(earlier["items"][i])
                    runs = merged(found)
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in runs))
                    items.append(sorted(named))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)]
                yield pa.RecordBatch.from_arrays([*base.columns, *new], names=[*base.schema.names, *RESULTS])

    return run


def report(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = scan(docs, benchmark, n=n, block_bytes=block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words.

    Spans run from the first byte of their first word to the last byte of their last word; the text
    around them is kept as it is. A document that is all span keeps an empty text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    columns = docs.columns
    # Own columns go under neutral names meanwhile, as they may clash with the scan's.
    back = {c: f"_own_{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text")}
    found = scan(renamed(docs, back), benchmark, n=n, block_bytes=block_bytes, keep=list(back.values()))
    if remove == "documents":
        return found.where("n_hit = 0").select(*[F.col(back.get(c, c)).alias(c) for c in columns])

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, runs in zip(text, spans):
            if t is None or runs is None or not len(runs):
                out.append(t)
                continue
            raw = t.encode()
            at = [m.span() for m in WORD.finditer(raw.lower())]
            left, end = [], 0
            for r in runs:
                left.append(raw[end : at[r["start"]][0]])
                end = at[r["end"] - 1][1]
            out.append(b"".join([*left, raw[end:]]).decode())
        return pd.Series(out, dtype=object)

    text = F.when(F.col("n_hit") > 0, cut("text", "spans")).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(back.get(c, c)).alias(c) for c in columns])
