"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 of 64 bits differ, by the pigeonhole principle, in at least
one bit inside one of three bit groups, or nowhere; with that group masked, at most 2 differing bits
are left. So every distinct fingerprint emits, for each of the three masks, all variants within half
of that radius (the masked word and its 1-bit neighbours); words at distance 2 or less share one.
Rows are shuffled on (mask, variant); the fingerprints that meet there are verified on all 64 bits,
and each place gives the edges of a spanning forest of its links, never all pairs.

A place where more than ``crowd`` distinct fingerprints meet is not solved in one task: its members
go through balls on all 64 bits, of radius 1 and 2. There a place holds at most 2,081 fingerprints,
and where one lies within 1 bit of it, all of them are links of that one. No link is lost either way.

Components come from alternating large-star and small-star steps over written edge tables.

Cases: null or empty texts, and texts of white space, have fingerprint zero and are linked like any
other; repeated rows and equal texts share a fingerprint; a null doc_id is never a component_id unless
its component has no other; an empty table gives an empty result; further columns are ignored.

``near_duplicates`` and ``deduplicate`` link texts whose sets of 5-word shingles have a Jaccard similarity of
0.8 or more. Such fingerprints differ in about 15 % of their bits, too many for balls, so longer ones are
searched in tables, and what is near by bits is verified by whole sets (see ``resemblance``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import resemblance
from tessella.llm.common import join_counted, materialize, renamed, slices, text_bytes
from tessella.llm.resemblance import majority, shingle_hashes

RADIUS = 3
GROUPS = ((1 << 22) - 1, ((1 << 43) - 1) ^ ((1 << 22) - 1), ((1 << 64) - 1) ^ ((1 << 43) - 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                hashes = [shingle_hashes(t, size) for t in text_bytes(batch["text"])]
                found = majority(np.array([x for h in hashes for x in h], np.uint64), np.array([len(h) for h in hashes], np.int64))
                others = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(found.view(np.int64))], names=[*others, "fp"])

    return run


def fingerprints(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _meet(crowd: int):
    """Edges (a, b) of a spanning forest of the links at each place, and (fp, fp) for each member of
    a crowded one. Rows come sorted by place, distinct. Of a place at the end of a batch, a task holds
    ``crowd`` members at most: those of a larger one pass on as they come."""
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def solve(fps: np.ndarray, out: list[np.ndarray]) -> None:
        if len(fps) > crowd:
            out.append(np.stack([fps, fps], 1))
            return
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
        left = np.ones(len(fps), bool)
        for i in range(len(fps)):
            if not left[i]:
                continue
            left[i], front = False, near[i] & left
            while front.any():
                out.append(np.stack([np.full(front.sum(), fps[i]), fps[front]], 1))
                left &= ~front
                front = near[front].any(axis=0) & left

    def places(columns: list[np.ndarray]) -> np.ndarray:
        mask, variant, fps = columns
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (variant[1:] != variant[:-1])]))
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        pairs = np.stack([fps[two], fps[two + 1]], 1)
        out = [pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            solve(fps[s : s + n], out)
        return np.unique(np.concatenate(out), axis=0)

    def rows(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64)) for i in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passing = none, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = [new[0].astype(np.int64), new[1], new[2].view(np.uint64)]
            if passing is not None:
                same = np.append((new[0] == passing[0]) & (new[1] == passing[1]), False)
                n = int(same.argmin())
                yield rows(np.stack([new[2][:n]] * 2, 1))
                new = [c[n:] for c in new]
                if not len(new[0]):
                    continue
                passing = None
            columns = [np.concatenate([a, b]) for a, b in zip(rest, new)]
            before = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(before[-1]) + 1 if len(before) else 0  # the last place may go on in the next batch
            rest = [c[cut:] for c in columns]
            if cut:
                yield rows(places([c[:cut] for c in columns]))
            if len(rest[0]) > crowd:
                yield rows(np.stack([rest[2]] * 2, 1))
                rest, passing = none, (rest[0][0], rest[1][0])
        if len(rest[0]):
            yield rows(places(rest))

    return run


def links(distinct: DataFrame, *, crowd: int = 2048) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the fingerprints ``fp``."""
    balls = [(g, signed(((1 << 64) - 1) ^ mask), signed(1 << b if b < 64 else 0)) for g, mask in enumerate(GROUPS) for b in [64, *(b for b in range(64) if not mask >> b & 1)]]
    literal = ", ".join(f"struct(tinyint({g}) AS g, bigint('{keep}') AS keep, bigint('{flip}') AS flip)" for g, keep, flip in balls)
    rows = distinct.select("fp", F.expr(f"explode(array({literal}))").alias("v"))
    rows = rows.select(F.col("v.g").alias("g"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("variant"), "fp")
    rows = rows.repartition("g", "variant").sortWithinPartitions("g", "variant")
    edges = materialize(rows.mapInArrow(_meet(crowd), "a long, b long").distinct(), "links")
    crowded = edges.where("a = b").select(F.col("a").alias("fp"))
    edges = edges.where("a <> b")
    if not crowded.head(1):
        return edges
    # Bits i and j are flipped; 64 stands for none, so i = j = 64 is the fingerprint itself.
    full = crowded.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64))))
    full = full.withColumn("j", F.explode(F.when(F.col("i") < 64, F.sequence(F.col("i") + 1, F.lit(64))).otherwise(F.array(F.lit(64)))))
    bit = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0).cast("long"))
    full = full.select("fp", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("place"), (F.col("j") == 64).alias("close"))
    hubs = full.where("close").groupBy("place").agg(F.min("fp").alias("hub"))
    # Spark takes exploded rows for few; neither side is small enough to be broadcast for sure.
    more = full.hint("merge").join(hubs.hint("merge"), "place").where("hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return edges.unionByName(materialize(more, "links-full"))


def components(edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the smallest node of its component.

    Alternates large-star and small-star until the edge table no longer changes. A node's smallest
    neighbour is a partial aggregate and goes back to its edges by ``join_counted``, so that no node's
    neighbours are gathered in one place."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        joined = join_counted(both, low, ["a"])
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges, before = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(most_rounds):
        edges = materialize(star(materialize(star(edges, True), "stars"), False), "stars")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def open_groups(places: DataFrame, stars: DataFrame, edges: DataFrame, *, crowd: int = 1024) -> DataFrame:
    """(node, root): groups of sets that hold together every two which share one of ``places``, but for places inside
    of one component of the links ``edges``. Places that reach each other over shared sets are one group, or as many as
    there are, whichever costs less. They are found by the trees of ``stars``, a link a set, and by what ties trees;
    a set is listed by its tree, not by its places."""
    trees = materialize(components(stars).withColumnRenamed("root", "tree"), "trees")
    known = materialize(trees.join(components(edges), "node", "left"), "known")
    found = resemblance.open_sets(places, known).withColumn("low", F.array_min("own.tree"))
    # A set that is in no tree has itself as its tree, and is tied to those of the others in its place.
    ties = materialize(found.select(F.col("low").alias("a"), F.explode(F.array_distinct("own.tree")).alias("b")).where("a <> b").distinct(), "ties")
    tied = materialize(components(ties) if ties.head(1) else ties.select(F.col("a").alias("node"), F.col("b").alias("root")), "tied")
    lows = found.groupBy("low").agg(F.count("*").alias("n"), F.sum(resemblance.cost(F.col("size"), crowd)).alias("apart"))
    lows = materialize(lows.join(tied, lows["low"] == tied["node"], "left").select("low", "n", "apart", F.coalesce("root", "low").alias("root")), "lows")
    found = join_counted(found, lows.select("low", "n", "root"), ["low"]).select("place", "own", "root")
    found = materialize(found, "open-groups")
    of_tree = trees.groupBy("tree").agg(F.count("*").alias("n")).join(tied, F.col("tree") == tied["node"], "left")
    of_tree = of_tree.select("tree", "n", F.coalesce("root", "tree").alias("root")).join(lows.select("root").distinct(), "root", "left_semi")
    nodes = join_counted(trees, materialize(of_tree, "of-tree"), ["tree"]).select("node", "root")
    nodes = materialize(nodes.unionByName(tied).distinct(), "open-nodes")
    sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
    sizes = lows.groupBy("root").agg(F.sum("n").alias("places"), F.sum("apart").alias("apart")).join(sizes, "root")
    sizes = materialize(sizes.withColumn("whole", resemblance.cost(F.col("size"), crowd) <= F.col("apart")), "sizes")
    whole = join_counted(nodes, sizes.where("whole").select("root", F.col("size").alias("n")), ["root"]).select("node", "root")
    apart = join_counted(found, sizes.where("NOT whole").select("root", F.col("places").alias("n")), ["root"])
    return whole.unionByName(apart.select(F.explode("own.fp").alias("node"), F.col("place").alias("root")))


def classes(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) for ``firsts`` (fp, n: its rows, first: its smallest doc_id) and the
    links ``edges`` (a, b); root: the smallest fp of the component, as a signed number."""
    roots = materialize(components(edges), "roots")
    linked = firsts.join(roots, firsts["fp"] == roots["node"]).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = materialize(linked.join(least, "root").select("fp", "root", "component_id"), "linked").withColumnRenamed("fp", "node")
    joined = firsts.join(linked, firsts["fp"] == linked["node"], "left")
    return joined.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))


def by_fingerprint(found: DataFrame, *, crowd: int = 2048) -> DataFrame:
    """(fp, n, root, component_id) for the distinct fingerprints of ``found`` (doc_id, fp)."""
    firsts = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    return classes(firsts, links(firsts.select("fp"), crowd=crowd))


def _of_documents(found: DataFrame, of_fp: DataFrame) -> DataFrame:
    return join_counted(found, materialize(of_fp, "classes"), ["fp"]).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, crowd: int = 1024) -> DataFrame:
    """(doc_id, fp, root, component_id) for every document; fp: the digest of its set of shingles;
    component_id: the smallest doc_id that is reachable over links, the document's own included."""
    found = materialize(resemblance.sketches(docs, size=size, similarity=similarity), "sketches")
    sets = materialize(resemblance.distinct_sets(found), "sets")
    options = {"size": size, "similarity": similarity, "crowd": crowd}
    places = resemblance.shared_places(sets, similarity=similarity, crowd=4 * crowd)
    stars = materialize(resemblance.best_hubs(places), "stars")
    edges = materialize(resemblance.verified_stars(docs, sets, stars, **options), "verified")
    left = materialize(open_groups(places, stars, edges, crowd=crowd), "open")
    if left.head(1):
        edges = edges.unionByName(materialize(resemblance.verified(docs, sets, left, **options), "verified-places"))
    return _of_documents(found.select("doc_id", "fp"), classes(sets.select("fp", "first", "n"), edges))


def deduplicate(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, crowd: int = 1024) -> DataFrame:
    """``docs`` with one document of each component of near copies: that with the smallest doc_id.
    Rows that repeat a doc_id inside a component count as copies too; one of them stays."""
    found = materialize(near_duplicates(docs, size=size, similarity=similarity, crowd=crowd), "near-duplicates")
    keepers = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    plain = found.agg(F.count("doc_id") == F.count("*")).first()[0] and not keepers.groupBy("doc_id").count().where("count > 1").head(1)
    if plain:
        return docs.join(keepers.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = renamed(docs, own).withColumns({"doc_id": F.col(own["doc_id"]), "text": F.col(own["text"])})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    rows = materialize(rows.mapInArrow(resemblance.digests(size), f"{schema}, fp long"), "digests")
    of_fp = found.groupBy("fp", "root", "component_id").agg(F.count("*").alias("n"))
    kept = join_counted(rows, materialize(of_fp, "of-fp"), ["fp"]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.dropDuplicates(["root"])
    return kept.select(*[F.col(o).alias(c) for c, o in own.items()])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 lower-case hex digits, component_id)."""
    found = materialize(fingerprints(docs), "fingerprints")
    return _of_documents(found, by_fingerprint(found)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
