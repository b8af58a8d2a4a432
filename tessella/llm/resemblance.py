"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

A fingerprint bit is 1 if it is set in over half the hashes of a set, so fingerprints of two sets differ in
a bit with the probability of their angle: sets at 0.8 have a cosine of 2 * 0.8 / 1.8 or more, which is 15 %
of the bits. No 64 bits with a small radius find such pairs, so fingerprints are longer, and are searched in
tables: each table has a key of a few bits that no other table has. The number of tables is that at which a
pair at 0.8 is a candidate in none with a probability of e^-14, 8e-7, and less above; keys get longer with the number
of rows, so that places (a key of a table) hold about 1,000 fingerprints at most.

1. In each place, fingerprints are compared on 128 other bits, which differ from table to table. Those within the
   radius (15 % and two standard deviations: 28 bits) are candidates there; the number of tables makes up for the
   2 % of pairs at 0.8 that are farther in one. Few that reach each other stay pairs, many are one group.
   A place of more than ``crowd`` fingerprints is dealt into blocks, and every two of its blocks meet in a task.
2. Each group has a hub, its smallest set. Each set is compared with one hub, that with which it shares
   most groups: one comparison a set, however many meet. Verified links make components.
3. A group whose sets are in one component by now can add nothing. The other groups (one of those with the same
   sets) overlap: texts that are all somewhat alike are in one group with each other in many tables. So those
   that reach each other over shared sets are taken as one, in which each set is listed once, unless that
   costs more than the groups by themselves (``cost``: rows and pairs). In each all sets are compared. A search
   that starts from one compares each found one with those not yet found only. A group of more than ``crowd``
   sets, or of long texts, is dealt into blocks, and every two of its blocks meet in one task.

No link stands on a fingerprint: pairs are compared by their whole sets, and no components are formed but by
links that are verified.

Cases: texts without words have the empty set, digest 0, and are copies of each other and of nothing
else; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_counted, join_listed, materialize, slices, text_bytes

SURE, NEAR_WORDS, FEW = 14, 2, 8
#: To read a text and hash its shingles takes about as long as so many comparisons.
ROW = 128
BLOCK_BYTES = 8 << 20


def shingle_hashes(text: bytes, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of every ``size``-word shingle of the lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - size]).tolist()]
    return [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def shingles(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _digest(own: np.ndarray) -> int:
    """Of a sorted set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64)) if len(own) else 0


def digests(size: int):
    """Replaces text by the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                found = [_digest(shingles(t, size)) for t in text_bytes(batch["text"])]
                others = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(found, pa.int64())], names=[*others, "fp"])

    return run


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of lists of hashes (``sizes`` of them each): a bit is 1 if it is set in over half the list."""
    counts = np.zeros((len(sizes), 64), np.int64)
    # 16-bit lanes: four counters in a word, over parts of at most 65,535 hashes.
    part = 65_535
    owner = np.repeat(np.arange(len(sizes)), -(-sizes // part))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    at = np.array([f + j * part for f, n in zip(first.tolist(), sizes.tolist()) for j in range(-(-n // part))], np.int64)
    if len(at):
        lanes = np.uint64(0x0001000100010001)
        for shift in range(16):
            sums = np.add.reduceat((flat >> np.uint64(shift)) & lanes, at).view(np.uint16).reshape(-1, 4)
            for lane in range(4):
                np.add.at(counts[:, 16 * lane + shift], owner, sums[:, lane])
    bits = counts * 2 > sizes[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def word_of(flat: np.ndarray, w: int) -> np.ndarray:
    """Word ``w`` of long hashes: the hashes themselves, then SplitMix64 of them."""
    if not w:
        return flat
    x = flat + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """The fingerprint of each set, in ``words`` words of 64 bits."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    return np.stack([majority(word_of(flat, w), sizes) for w in range(words)], 1)


def share(similarity: float) -> float:
    """Of bits in which fingerprints of two sets with that similarity differ at most, by expectation."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    n, p = 64 * NEAR_WORDS, share(similarity)
    return math.ceil(n * p + 2 * math.sqrt(n * p * (1 - p)))


def within(similarity: float) -> float:
    """The share of pairs with that similarity whose words are within the radius."""
    n, p = 64 * NEAR_WORDS, share(similarity)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(radius(similarity) + 1))


def key_bits(rows: int) -> int:
    return max(12, math.ceil(math.log2(max(rows, 1) / 1024)))


def tables(bits: int, similarity: float) -> int:
    return math.ceil(SURE / -math.log1p(-((1 - share(similarity)) ** bits) * within(similarity)))


def table_keys(found: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The place of each fingerprint in each of ``count`` tables; no two tables share bits."""
    each, mask = 64 // bits, np.uint64((1 << bits) - 1)
    keys = [(found[:, t // each] >> np.uint64(t % each * bits)) & mask | np.uint64(t << bits) for t in range(count)]
    return np.stack(keys, 1).view(np.int64)


def _sketches(size: int, bits: int, count: int):
    words = NEAR_WORDS + -(-count // (64 // bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = text_bytes(batch["text"])
                sets = [shingles(t, size) for t in texts]
                found = prints(sets, words)
                keys = [k if len(s) else [] for k, s in zip(table_keys(found, bits, count).tolist(), sets)]
                new = [pa.array([_digest(s) for s in sets], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                new.append(pa.array(found.view(np.int64).tolist(), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["h2"], *new], names=["doc_id", "h", "h2", "fp", "bytes", "keys", "print"])

    return run


def _keys() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2")]


def sketches(docs: DataFrame, *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, h2, fp, bytes, keys, print): two hashes and the bytes of the text, the digest of its set,
    the places of its SimHash fingerprint (none for an empty set) and that one's words."""
    bits = key_bits(docs.count())
    run = _sketches(size, bits, tables(bits, similarity))
    return docs.select("doc_id", *_keys(), "text").mapInArrow(run, "doc_id long, h long, h2 long, fp long, bytes long, keys array<long>, print array<long>")


def distinct_sets(found: DataFrame) -> DataFrame:
    """(fp, n, first, one, keys, print) for each distinct set: its rows, its smallest doc_id, one of its texts."""
    same = [F.min(c).alias(c) for c in ("keys", "print")]
    return found.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min(F.struct("bytes", "h", "h2")).alias("one"), *same)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def with_near(starts: np.ndarray, marks: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints (rows of ``marks``) have another within ``most`` bits in their place, that begins at ``starts``."""
    sizes = np.diff(np.append(starts, len(marks)))
    out, small = np.zeros(len(marks), bool), np.repeat(sizes <= 32, sizes)
    rows, place = np.flatnonzero(small), np.repeat(np.arange(len(sizes)), sizes)[small]
    for step in range(1, 32):
        at = np.flatnonzero(place[step:] == place[:-step])
        if not len(at):
            break
        a, b = rows[at], rows[at + step]
        near = _differ(marks[a], marks[b]) <= most
        out[a[near]] = out[b[near]] = True
    for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        own = marks[s : s + n]
        for i in range(0, n, 256):
            part = own[i : i + 256]
            far = sum(np.bitwise_count(part[:, w, None] ^ own[None, :, w]) for w in range(own.shape[1]))
            out[s + i : s + i + len(part)] = (far <= most).sum(axis=1) > 1  # each is near itself
    return out


def reach(marks: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups of two and more that reach each other by steps of up to ``most`` bits."""
    left, out = np.ones(len(marks), bool), []
    for i in range(len(marks)):
        if not left[i]:
            continue
        left[i], front, own = False, [i], [i]
        while front:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            x = front.pop()
            near = rest[_differ(marks[rest], marks[x]) <= most]
            left[near] = False
            front.extend(near.tolist())
            own.extend(near.tolist())
        if len(own) > 1:
            out.append(np.array(own))
    return out


def _meet(most: int, crowd: int | None):
    """(place, part, a, fp) for the members ``fp`` of each group, a: its smallest. Rows come sorted by place. Members of
    a place of more than ``crowd`` pass on as they are, with null for a, so that a task holds few of them."""
    names = ["place", "part", "a", "fp", "s0", "s1"]

    def solve(places: np.ndarray, fps: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        rows = np.flatnonzero(with_near(starts, marks, most))
        places, fps, marks = places[rows], fps[rows], marks[rows]
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(rows) else rows
        out = []
        for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(rows))).tolist()):
            for own in reach(marks[s : s + n], most):
                own = own + s
                if len(own) > FEW:
                    a = int(fps[own].min())
                    out.extend((int(places[s]), a, a, x) for x in fps[own].tolist())
                    continue
                i, j = np.triu_indices(len(own), 1)
                near = _differ(marks[own[i]], marks[own[j]]) <= most
                for x, y in zip(fps[own[i[near]]].tolist(), fps[own[j[near]]].tolist()):
                    a, b = min(x, y), max(x, y)
                    out += [(int(places[s]), b, a, a), (int(places[s]), b, a, b)]
        found = np.array(out, np.int64).reshape(-1, 4)
        blank = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(4)), blank, blank], names=names)

    def passed(columns: list[np.ndarray]) -> pa.RecordBatch:
        place, *own = (pa.array(c) for c in columns)
        blank = pa.nulls(len(place), pa.int64())
        return pa.RecordBatch.from_arrays([place, blank, blank, *own], names=names)

    def groups(columns: list[np.ndarray]) -> pa.RecordBatch:
        return solve(columns[0], columns[1], np.stack(columns[2:], 1).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passing = [[] for _ in range(4)], None
        n_rest = 0
        for batch in batches:
            new = [batch[c].to_numpy(zero_copy_only=False) for c in ("place", "fp", "s0", "s1")]
            if passing is not None:
                n = int(np.append(new[0] == passing, False).argmin())
                yield passed([c[:n] for c in new])
                new = [c[n:] for c in new]
            if not len(new[0]):
                continue
            passing = None
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last place may go on in the next batch
            if cut or n_rest and rest[0][0][0] != new[0][-1]:
                yield groups([np.concatenate([*r, c[:cut]]) for r, c in zip(rest, new)])
                rest, n_rest = [[] for _ in range(4)], 0
            for r, c in zip(rest, new):
                r.append(c[cut:])
            n_rest += len(new[0]) - cut
            if crowd is not None and n_rest > crowd:
                passing = int(new[0][-1])
                yield passed([np.concatenate(r) for r in rest])
                rest, n_rest = [[] for _ in range(4)], 0
        if n_rest:
            yield groups([np.concatenate(r) for r in rest])

    return run


def shared_places(sets: DataFrame, *, similarity: float = 0.8, crowd: int = 4096) -> DataFrame:
    """(place, a, fp): the sets of each group of candidates, and the smallest of them."""
    schema, most = "place long, part long, a long, fp long, s0 long, s1 long", radius(similarity)
    # The words after that of the key, which differ from table to table: no pair depends on two words.
    word = lambda i: F.expr(f"element_at(print, cast(t div ceil(size(keys) / (size(print) - {NEAR_WORDS})) as int) + {i + 2})").alias(f"s{i}")
    rows = sets.select("*", F.posexplode("keys").alias("t", "place")).select("place", "fp", word(0), word(1))
    rows = rows.repartition("place").sortWithinPartitions("place")
    found = materialize(rows.mapInArrow(_meet(most, crowd), schema), "places")
    crowded, found = found.where("a IS NULL").select("place", "fp", "s0", "s1"), found.where("a IS NOT NULL")
    if crowded.head(1):
        blocks = F.ceil(F.count("*") * 2 / crowd).cast("int")
        counted = materialize(crowded.groupBy("place").agg(F.count("*").alias("n"), blocks.alias("blocks")), "crowded")
        rows = join_listed(crowded, counted, "place").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))))
        pair = F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(pair.alias("place"), "fp", "s0", "s1").repartition("place").sortWithinPartitions("place")
        found = found.unionByName(materialize(rows.mapInArrow(_meet(most, None), schema), "places"))
    return materialize(found.select(F.xxhash64("place", "part", "a").alias("place"), "a", "fp"), "shared-places")


def best_hubs(places: DataFrame) -> DataFrame:
    """(a, b): for each set the hub with which it shares most groups, the smaller one of equals."""
    pairs = places.where("a <> fp").groupBy("fp", "a").agg(F.count("*").alias("n"))
    return pairs.groupBy(F.col("fp").alias("b")).agg(F.min(F.struct(-F.col("n"), "a")).getField("a").alias("a")).select("a", "b")


def open_sets(places: DataFrame, known: DataFrame) -> DataFrame:
    """(place, size, own) for each place that is in more than one component of ``known`` (node, root, tree); own: its
    sets (fp, tree), as many as a task holds of a place. Of places with the same sets (by 128 bits of hashes) one is enough."""
    of, own = F.coalesce("root", "fp"), F.collect_list(F.struct("fp", F.coalesce("tree", "fp").alias("tree"))).alias("own")
    rows = places.join(known, places["fp"] == known["node"], "left")
    marks = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"m{i}") for i in range(2)]
    each = rows.groupBy("place").agg((F.min(of) < F.max(of)).alias("open"), F.count("*").alias("size"), own, *marks).where("open")
    one = each.groupBy("size", "m0", "m1").agg(F.min("place").alias("place"), F.min_by("own", "place").alias("own"))
    return materialize(one.select("place", "size", "own"), "open-places")


def open_places(places: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the sets of each place that is in more than one component of ``roots`` (node, root); the place
    is the root here."""
    found = open_sets(places, roots.withColumn("tree", F.col("node")))
    return found.select(F.explode("own.fp").alias("node"), F.col("place").alias("root"))


def cost(n, crowd: int):
    """Of comparing ``n`` sets with each other: texts that are read, as comparisons, and comparisons."""
    return F.lit(ROW) * n * F.ceil(n / crowd) + n * n / 2


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` with at least that similarity, of which each set that is linked to
    others has enough to reach all that it can reach."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, left, out = np.zeros(len(names), bool), np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            x = front.pop()
            # Sets of very different sizes cannot be that similar.
            a, b = np.searchsorted(sizes, [similarity * sizes[x] - 1e-6, sizes[x] / similarity + 1e-6])
            if not left[a:b].any():
                continue
            own = flat[starts[x] : starts[x + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[flat[starts[a] : starts[b]]], starts[a:b] - starts[a], dtype=np.int64)
            mark[own] = False
            near = a + np.flatnonzero(left[a:b] & (both * (1 + similarity) >= similarity * (sizes[x] + sizes[a:b]) - 1e-9))
            left[near] = False
            front.extend(near.tolist())
            out.extend((int(order[x]), int(order[y])) for y in near)
    return out


def _verify(size: int, similarity: float):
    """Rows come sorted by (root, i, j)."""

    def solve(fps: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = forest([shingles(t, size) for t in texts], similarity)
        return pa.RecordBatch.from_arrays([pa.array([fps[x] for x, _ in found], pa.int64()), pa.array([fps[y] for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fps, texts = None, [], []
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("root", "i", "j", "fp")))
            for (*key, fp), text in zip(keys, batch["text"].cast(pa.binary())):
                if key != last and fps:
                    yield solve(fps, texts)
                    fps, texts = [], []
                last = key
                fps.append(fp)
                texts.append(text.as_py() or b"")
        if fps:
            yield solve(fps, texts)

    return run


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-9


def _against_hubs(size: int, similarity: float):
    """Rows come sorted by (root, own, member), each root's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for key, member, fp, text in zip(batch["root"].to_pylist(), batch["member"].to_pylist(), batch["fp"].to_pylist(), batch["text"].cast(pa.binary())):
                own = shingles(text.as_py() or b"", size)
                if not member:
                    root, hub = key, own
                elif key == root and similar(hub, own, similarity):
                    a.append(root)
                    b.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _texts(docs: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """``members`` (h, h2, fp, root, ...) with their texts."""
    texts = docs.select(*_keys(), "text").dropDuplicates(["h", "h2"])
    return texts.hint("merge").join(members.select("h", "h2", "fp", "root", *more).hint("merge"), ["h", "h2"])


def _sized(groups: DataFrame, sets: DataFrame, crowd: int, *more: str) -> DataFrame:
    """``groups`` (node, root) with their sets' ``one`` text, and ``blocks`` for each root."""
    members = materialize(groups.join(sets, groups["node"] == sets["fp"]).select("fp", "root", *more, "one.*"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / crowd), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    counted = materialize(members.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")), "blocks")
    return join_counted(members, counted, ["root"])


def verified_stars(docs: DataFrame, sets: DataFrame, stars: DataFrame, *, size: int = 5, similarity: float = 0.8, crowd: int = 1024) -> DataFrame:
    """Those of ``stars`` (a, b) that are similar. A hub's members are dealt into blocks, and the hub goes to each."""
    rows = stars.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("member"))
    hubs = stars.select(F.col("a").alias("node"), F.col("a").alias("root"), F.lit(False).alias("member")).distinct()
    members = _sized(rows.unionByName(hubs), sets, crowd, "member")
    own = F.when(F.col("member"), F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = _texts(docs, members, "member", "blocks").withColumn("own", F.explode(own)).select("root", "own", "member", "fp", "text")
    rows = rows.repartition("root", "own").sortWithinPartitions("root", "own", "member")
    return rows.mapInArrow(_against_hubs(size, similarity), "a long, b long")


def verified(docs: DataFrame, sets: DataFrame, groups: DataFrame, *, size: int = 5, similarity: float = 0.8, crowd: int = 1024) -> DataFrame:
    """Edges (a, b) whose components are those of all similar pairs inside ``groups`` (node, root)."""
    members = _sized(groups, sets, crowd)
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = _texts(docs, members, "blocks", "own")
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(_verify(size, similarity), "a long, b long").distinct()
