"""Suffix-array dedup: repeated 200-byte strings, found by bucket-pointer refinement.

Bucket-pointer refinement first sorts suffixes into q-gram buckets and then refines each bucket by
the bucket identifiers of later offsets; what one refinement has found is used by the next. The
identifier of a 2q-gram is made from those of the q-gram at the same offset and of the q-gram q bytes
later, from bytes up to 128-grams, over and over, so every task computes it alike and no table of
ranks is passed around. Each refinement gives its buckets numbers (pointers), and the next one
compares only what is new below such a pointer.

Sorting every suffix of the corpus would shuffle many times its size. Only sampled suffixes are
dealt out: each ``length``-byte string is represented by the one 32-gram in it with the smallest
identifier (its anchor). Equal strings have equal anchors at equal places, so every repeat shows up
in the bucket of an anchor. Then, bucket by bucket:

1. q-gram buckets: anchors whose 32-gram is unique are done.
2. Refinement by the whole surroundings, i.e. by all strings that hold the anchor: where equal, all
   those strings repeat. Buckets in which all surroundings are equal are done; the others get pointers.
3. Refinement below those, for each run of 13 offsets of the anchor inside the string: by what all
   strings of the run have in common (a bucket with one member is done, nothing repeats) and by what
   they span together (where equal, all of them repeat). What is left gets pointers again.
4. Refinement below those, for each offset, i.e. string, alone: by the 12 bytes that it has besides
   what its run has in common. These are compared as they are.

Surroundings, common parts and spans are compared by two independent 64-bit identifiers (128 bits)
inside the bucket that they refine; a 32-gram is a bucket only and proves nothing.

Equal members of a bucket are counted by partial aggregates and only one of each goes on to the next
refinement, so large groups of copies cost no more than their own rows. Joins back to members go by
``join_counted``: keys with many rows are broadcast (their number is bounded), so none is one task.

Cases: null text is empty; texts shorter than ``length`` bytes lose nothing; rows with a repeated
doc_id are documents of their own, and equal rows are copies of each other; null doc_ids take part;
an empty table gives an empty result. Texts come back with whole characters: one of which a byte is
kept stays (the digest of ``report`` is over bytes). Further columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_counted, materialize, release, renamed, slices, text_bytes

GRAM = 32
BLOCK = 128
PIECE = 1 << 18
RUN = 13
U = np.uint64
#: Identifiers of single bytes, for either kind, and multipliers: any fixed random numbers.
BYTE, OTHER = (np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (20, 21))
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
BASE = 0x2545F4914F6CDD1D
#: Powers of an odd base, and of its inverse modulo 2**64.
POWERS, INVERSE = (np.cumprod(np.concatenate([[U(1)], np.full(PIECE + 4096, U(x))]), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its two parts."""
    x = a * M1
    x ^= (b ^ (b >> U(31))) * M2
    x ^= x >> U(29)
    x *= M3
    x ^= x >> U(32)
    return x


def doubled(raw: np.ndarray, want: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Identifiers of the q-grams that start at each place of the last axis, for each wanted q."""
    ids, q, out = BYTE[raw], 1, {}
    while True:
        if q in want:
            out[q] = ids
        if q == max(want):
            return out
        ids = joined(ids[..., : max(0, ids.shape[-1] - q)], ids[..., q:])
        q *= 2


def spanned(blocks: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Identifiers of the strings of ``size`` (128 to 384) bytes at ``start``, from their blocks."""
    flat = blocks.reshape(-1)
    a, b, c = flat[start], flat[start + (size - BLOCK) // 2], flat[start + size - BLOCK]
    return joined(joined(joined(a, b), c), size.astype(np.uint64))


def sums(raw: np.ndarray) -> np.ndarray:
    """Running sums over the last axis that give the second identifier of any string of it."""
    out = np.zeros((*raw.shape[:-1], raw.shape[-1] + 1), np.uint64)
    np.cumsum(OTHER[raw] * POWERS[: raw.shape[-1]], axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def summed(running: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The second identifiers of strings of ``size`` bytes at ``start`` of the flat running sums;
    ``at``: their offsets inside their own rows."""
    flat = running.reshape(-1)
    x = (flat[start + size] - flat[start]) * INVERSE[at]
    return x ^ (x >> U(32))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of a text: place, 32-gram identifier, the two identifiers of the span of all strings
    of which it is the anchor, and the least and greatest offset of the anchor inside those strings."""
    n, back = len(text), length - GRAM
    raw = np.frombuffer(text, np.uint8)
    found = []
    for s in range(0, n if n >= length else 0, PIECE):
        lo, hi = max(0, s - 2 * back), min(n, s + PIECE + 2 * length)
        ids = doubled(raw[lo:hi], (GRAM, BLOCK))
        grams, blocks = ids[GRAM], ids[BLOCK]
        order = (grams >> U(21) << U(21)) | np.arange(len(grams), dtype=np.uint64)
        of_string = (sliding_least(order, back + 1) & U((1 << 21) - 1)).astype(np.int64)  # never falls
        first = np.flatnonzero(np.concatenate([[True], of_string[1:] != of_string[:-1]]))
        last = np.append(first[1:], len(of_string)) - 1
        at = of_string[first]
        own = (at + lo >= s) & (at + lo < s + PIECE)
        at, first, last = at[own], first[own], last[own]
        low, high = at - last, at - first
        size, offsets = last - first + length, (low * 1024 + high).astype(np.uint64)
        hull = joined(spanned(blocks, first, size), offsets)
        other = summed(sums(raw[lo:hi]), first, size, first) + offsets * M2
        found.append((at + lo, grams[at], hull, other, low, high))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def keyed(docs: DataFrame) -> DataFrame:
    """(k, s, text): k and s tell documents apart, unless both doc_id and text are equal."""
    return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.xxhash64("doc_id", "text").alias("s"), "text")


def _cut_to(x: np.ndarray, bits: int) -> pa.Array:
    return pa.array((x & U((1 << bits) - 1)).view(np.int64))


def _anchors(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                parts = [anchors_of(t, length) for t in text_bytes(batch["text"])]
                if not parts:
                    continue
                rows = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
                at, grams, hull, other, low, high = (np.concatenate([p[x] for p in parts]) for x in range(6))
                place = at * 65536 + low * 256 + high
                columns = [batch["k"].take(rows), batch["s"].take(rows), pa.array(place), _cut_to(grams, bits), _cut_to(hull, bits), pa.array(other.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "place", "gram", "hull", "hull2"])

    return run


def _strings(length: int):
    """For each listed anchor of a document: the span of the strings that it is the anchor of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                k, s, lists = batch["k"].to_pylist(), batch["s"].to_pylist(), batch["anchors"].to_pylist()
                rows = []
                for i, text in enumerate(text_bytes(batch["text"])):
                    for a in lists[i]:
                        at, low, high = a["place"] >> 16, a["place"] >> 8 & 255, a["place"] & 255
                        rows.append((k[i], s[i], a["place"], a["bucket"], a["alone"], text[at - high : at - low + length]))
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "s", "place", "bucket", "alone", "span"])

    return run


def _spans(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of a batch as rows of bytes with the anchor at one place, and the least and greatest
    offset of each anchor."""
    back, place = length - GRAM, batch["place"].to_numpy()
    raw = np.zeros((batch.num_rows, back + length), np.uint8)
    least, most = place >> 8 & 255, place & 255
    for i, (span, high) in enumerate(zip(batch["span"].to_pylist(), most.tolist())):
        raw[i, back - high : back - high + len(span)] = np.frombuffer(span, np.uint8)
    return raw, least, most


def _runs(length: int, bits: int):
    """One row for each run of offsets of each anchor: below the pointer of its bucket, the two
    identifiers of what the run's strings have in common, and of what those strings that the anchor
    is of span. ``ref`` holds the anchor's number and whether it is open, ``first`` the first offset."""
    back = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw, least, most = _spans(batch, length)
                blocks, running = doubled(raw, (BLOCK,))[BLOCK], sums(raw)
                low = np.broadcast_to(np.arange(0, back + 1, RUN), (len(raw), back // RUN + 1))
                row, _ = np.nonzero(fits := (low <= most[:, None]) & (low + RUN - 1 >= least[:, None]))
                low = low[fits]
                a, b = np.maximum(low, least[row]), np.minimum(low + RUN - 1, most[row])

                def both(start: np.ndarray, size: np.ndarray) -> list[pa.Array]:
                    first = spanned(blocks, row * blocks.shape[1] + start, size)
                    return [_cut_to(first, bits), pa.array(summed(running, row * running.shape[1] + start, size, start).view(np.int64))]

                common = both(back - low, np.full(len(row), length - RUN + 1))
                # Of equal common parts, spans are alike if they reach equally far and are equal.
                hull = both(back - b, b - a + length)
                reach = pa.array((a * 1024 + b).astype(np.int32))
                ref = (batch["nid"].to_numpy()[row] << 1) | batch["alone"].to_numpy(zero_copy_only=False)[row]
                columns = [batch["bucket"].take(pa.array(row)), pa.array(low.astype(np.int32)), *common, reach, *hull, pa.array(ref.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "first", "c1", "c2", "reach", "h1", "h2", "ref"])

    return run


def _singles(length: int):
    """One row for each offset in the listed runs of each anchor: below the run's pointer, the 12 bytes
    that the string has before and after what the run has in common."""
    back, rest = length - GRAM, RUN - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw, least, most = _spans(batch, length)
                lists = batch["runs"].to_pylist()
                row = np.repeat(np.arange(len(raw)), [len(x) for x in lists])
                first = np.array([x["first"] for runs in lists for x in runs], np.int64)
                pointer = np.array([x["run"] for runs in lists for x in runs], np.int64)
                row, first, pointer = (np.repeat(x, RUN) for x in (row, first, pointer))
                j = np.tile(np.arange(RUN), len(row) // RUN)
                own = (first + j >= least[row]) & (first + j <= most[row])
                row, first, pointer, j = row[own], first[own], pointer[own], j[own]
                t = np.arange(rest)
                column = (back - first - j)[:, None] + t + np.where(t >= j[:, None], length - rest, 0)
                found = np.zeros((len(row), 16), np.uint8)
                found[:, :rest] = raw[row[:, None], column]
                words = found.view(np.int64)
                ref = (batch["nid"].to_numpy()[row] << 1) | batch["alone"].to_numpy(zero_copy_only=False)[row]
                columns = [pa.array(pointer), pa.array((first + j).astype(np.int32)), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(ref.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "offset", "w1", "w2", "ref"])

    return run


def repeats(docs: DataFrame, *, length: int = 200, bits: int = 64) -> DataFrame:
    """(k, s, spans) for documents, as ``keyed`` names them, with bytes that a repeated string of
    ``length`` bytes covers; spans: (start, end) that cover them, in no order. ``bits``: how much of the
    first of the two identifiers is used (tests force collisions by it)."""
    if not 160 <= length <= 200:
        raise ValueError("length is between 160 and 200")
    long = keyed(docs).where(F.octet_length("text") >= length)

    # Buckets by 32-gram, and by all strings of the anchor.
    every = materialize(long.mapInArrow(_anchors(length, bits), "k long, s long, place long, gram long, hull long, hull2 long"), "anchors")
    grams = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    anchors = materialize(join_counted(every, grams, ["gram"], "left_semi"), "shared-anchors")
    release(every, grams)
    whole = ["gram", "hull", "hull2"]
    hulls = materialize(anchors.groupBy(*whole).agg(F.count("*").alias("n"), F.min(F.struct("k", "s", "place")).alias("one")), "hulls")
    twins = join_counted(anchors, hulls.where("n > 1").select(*whole, "n"), whole, "left_semi")
    at, low, high = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    covered = twins.select("k", "s", (at - high).alias("start"), (at - low + length).alias("end"))

    # Pointers for the buckets that are left, and the strings of their anchors, one of equal ones.
    mixed = hulls.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumn("bucket", F.monotonically_increasing_id())
    mixed = materialize(mixed, "mixed")
    unsure = join_counted(hulls.select("gram", "one", (F.col("n") == 1).alias("alone")), mixed, ["gram"])
    listed = unsure.select("one.*", "bucket", "alone").groupBy(F.col("k").alias("lk"), F.col("s").alias("ls")).agg(F.collect_list(F.struct("place", "bucket", "alone")).alias("anchors"))
    once = long.join(listed, (long["k"] == F.col("lk")) & (long["s"] == F.col("ls"))).select("k", "s", "text", "anchors")
    near = once.mapInArrow(_strings(length), "k long, s long, place long, bucket long, alone boolean, span binary")
    near = materialize(near.withColumn("nid", F.monotonically_increasing_id()), "near")

    # Buckets by runs of offsets, below those. A bucket counts if it has two members and an open one.
    cut = materialize(near.mapInArrow(_runs(length, bits), "bucket long, first int, c1 long, c2 long, reach int, h1 long, h2 long, ref long"), "runs")
    is_open = F.max(F.col("ref").bitwiseAND(1)) == 1
    of, hull = ["bucket", "first", "c1", "c2"], ["run", "reach", "h1", "h2"]
    differs = F.min(F.struct(*hull[1:])) != F.max(F.struct(*hull[1:]))
    kinds = cut.groupBy(*of).agg(F.count("*").alias("n"), is_open.alias("open"), differs.alias("mixed")).where("n > 1 AND open")
    kinds = materialize(kinds.select(*of, "n", "mixed", F.monotonically_increasing_id().alias("run")), "kinds")
    shared = materialize(join_counted(cut, kinds, of).select(*hull, "first", "ref", "mixed"), "shared-runs")
    release(cut, kinds)
    alike = materialize(shared.groupBy(*hull).agg(F.count("*").alias("n"), F.min("ref").alias("one")).where("n > 1"), "alike")
    runs = materialize(join_counted(shared, alike, hull, "left"), "known-runs").withColumnRenamed("n", "m")
    release(shared, alike)
    nid = F.shiftright("ref", 1)
    whole_runs = runs.where("m IS NOT NULL AND ref % 2 = 1").select(nid.alias("id"), "first", F.lit(RUN).alias("span"))

    # Buckets by single offsets, below runs that are in part alike; of equal runs, one goes on.
    split = runs.where("mixed AND (m IS NULL OR ref = one)").groupBy(nid.alias("id")).agg(F.collect_list(F.struct("first", "run")).alias("runs"))
    single = near.join(split, near["nid"] == split["id"]).select("nid", "place", "alone", "span", "runs")
    single = materialize(single.mapInArrow(_singles(length), "run long, offset int, w1 long, w2 long, ref long"), "single")
    of = ["run", "offset", "w1", "w2"]
    twice = single.groupBy(*of).agg(F.count("*").alias("n"), is_open.alias("open")).where("n > 1 AND open")
    twice = materialize(twice.select(*of, "n"), "twice")
    ones = join_counted(single, twice, of, "left_semi").where("ref % 2 = 1").select(nid.alias("id"), F.col("offset").alias("first"), F.lit(1).alias("span"))

    found = whole_runs.unionByName(ones).groupBy("id").agg(F.collect_list(F.struct("first", "span")).alias("parts"))
    more = near.join(found, near["nid"] == found["id"]).select("k", "s", at.alias("at"), low.alias("low"), high.alias("high"), F.explode("parts").alias("p"))
    more = more.select("k", "s", (F.col("at") - F.least(F.col("p.first") + F.col("p.span") - 1, F.col("high"))).alias("start"), (F.col("at") - F.greatest("p.first", "low") + length).alias("end"))
    return covered.unionByName(more).groupBy("k", "s").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(as_text: bool, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                spans, texts, nulls = batch["spans"].to_pylist(), text_bytes(batch["text"]), batch["text"].is_null().to_pylist()
                n_bytes, n_removed, n_spans, out = [], [], [], []
                for text, found, null in zip(texts, spans, nulls):
                    runs = merged([(r["start"], r["end"]) for r in found or []], len(text))
                    n_bytes.append(len(text))
                    n_removed.append(sum(b - a for a, b in runs))
                    n_spans.append(len(runs))
                    if as_text:  # a character of which a byte stays, stays
                        runs = [(a + _inside(text, a, 1), b - _inside(text, b, -1)) for a, b in runs]
                    left = [text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(max(a, 0) for a, _ in runs), len(text)])]
                    rest = b"".join(left)
                    out.append((None if null else rest.decode("utf-8", "replace")) if as_text else hashlib.sha256(rest).hexdigest())
                own = [batch[c] for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(out, pa.string())], names=[*kept, "n_bytes", "n_removed", "n_spans", "out"])

    return run


def _inside(text: bytes, at: int, step: int) -> int:
    """Bytes from ``at`` to the next (or, with -1, the last) start of a character."""
    moved = 0
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at, moved = at + step, moved + 1
    return moved


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    found = materialize(repeats(docs, length=length), "repeats")
    found = found.select(F.col("k").alias("fk"), F.col("s").alias("fs"), "spans")
    rows = docs.withColumns({"k": F.coalesce("doc_id", F.lit(-1)), "s": F.xxhash64("doc_id", "text")})
    return rows.join(found, (F.col("k") == F.col("fk")) & (F.col("s") == F.col("fs")), "left").drop("fk", "fs", "k", "s")


def report(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    rows = _with_spans(docs.select("doc_id", "text"), length).select("doc_id", "text", "spans")
    out = rows.mapInArrow(_cut(False, ["doc_id"]), "doc_id long, n_bytes long, n_removed long, n_spans long, out string")
    return out.withColumnRenamed("out", "kept_sha256")


def remove_repeats(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """``docs`` with all repeated strings taken out of ``text``; a document of which nothing else is
    left goes."""
    columns = docs.columns
    own = {c: f"_own_{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text")}
    rows = _with_spans(renamed(docs, own), length)
    kept = [*own.values(), "doc_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    out = rows.mapInArrow(_cut(True, kept), f"{schema}, n_bytes long, n_removed long, n_spans long, out string")
    out = out.where("n_removed = 0 OR trim(out) <> ''")
    return out.select(*[F.col("out" if c == "text" else own.get(c, c)).alias(c) for c in columns])
