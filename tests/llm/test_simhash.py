import random

import numpy as np
import pytest
import xxhash
from tessella.llm import resemblance, simhash
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents, words


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(fps))]
    least = {}
    for r, d in zip(roots, ids):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in roots]


def check(frame, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash.digest(frame).collect()) == want


def test_real_documents_match_brute_force(spark):
    frame = documents(spark)
    check(frame, [(r.doc_id, r.text) for r in frame.collect()])


def test_awkward_documents(spark):
    frame = awkward_documents(spark)
    check(frame, [(r.doc_id, r.text) for r in frame.collect()])


def test_empty_table(spark):
    assert simhash.digest(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


@pytest.mark.parametrize("crowd", [2, 2048])
def test_links_keep_every_component(spark, crowd):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(12)):
            fps.add(base := base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, crowd=crowd)).collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(simhash.signed(f), simhash.signed(f)), set()).add(i)
    want = {}
    for i, c in enumerate(brute_components(list(range(len(fps))), fps)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_deduplicate_keeps_one_of_each(spark):
    frame = awkward_documents(spark)
    classes = {(r.fp, r.component_id): r.root for r in simhash.near_duplicates(frame).collect()}
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(set(classes.values()))


def brute_near_copies(rows, size=5, least=0.8):
    """The component_id of each row, by the Jaccard similarity of all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    holders = {}
    for i, s in enumerate(sets):
        for g in s or {None}:
            holders.setdefault(g, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n_links = 0
    for i, s in enumerate(sets):
        both = {}
        for g in s or {None}:
            for j in holders[g]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= least - 1e-12:
                n_links += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    firsts = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            firsts[find(i)] = min(firsts.get(find(i), doc), doc)
    return [firsts.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("make, crowd", [(documents, 1024), (awkward_documents, 1024), (awkward_documents, 2)])
def test_near_copies_match_brute_force(spark, make, crowd):
    frame = make(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = sorted((str(d), str(c)) for (d, _), c in zip(rows, brute_near_copies(rows)))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(frame, crowd=crowd).collect()) == want


def test_edited_copies_go(spark):
    """Copies of which one word in 60 differs share over 0.8 of their 5-word shingles."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        text = words(rng, 120).split()
        edited = [*text[:30], "new", *text[31:90], "word", *text[91:]]
        rows += [(2 * i, " ".join(text), "en", "a", 1), (2 * i + 1, " ".join(edited), "en", "a", 1)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOC_SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_a_chain_is_verified_link_by_link(spark):
    """Texts that are each like the next, the ends with nothing in common: one comparison each, and some in small
    places, of 4.5 million pairs."""
    rng = random.Random(11)
    stream = words(rng, 3000 * 12 + 200).split()
    texts = [" ".join(stream[12 * i : 12 * i + 150]) for i in range(3000)]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC_SCHEMA)
    sets = resemblance.distinct_sets(resemblance.sketches(frame))
    places = resemblance.shared_places(sets)
    stars = resemblance.best_hubs(places)
    assert stars.count() < 3000
    edges = resemblance.verified_stars(frame, sets, stars)
    left = resemblance.open_places(places, simhash.components(edges)).groupBy("root").count().collect()
    assert max(r["count"] for r in left) < 20 and sum(r["count"] * (r["count"] - 1) // 2 for r in left) < 75_000
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {0}


def test_places_of_unlike_sets(spark):
    """Families that share half of their shingles meet in places, but stay apart; crowded places go by blocks."""
    rng = random.Random(12)
    base, rows = words(rng, 200).split(), []
    for f in range(12):
        own = [*base[:100], *words(rng, 100).split()]
        for i in range(6):
            edited = [*own]
            edited[rng.randrange(200)] = f"w{f}x{i}"
            rows.append((6 * f + i, " ".join(edited), "en", "a", 1))
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    for crowd in (1024, 4):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, crowd=crowd).collect()}
        assert got == {i: c for (i, *_), c in zip(rows, brute_near_copies([(r[0], r[1]) for r in rows]))}
    assert len(set(got.values())) == 12


def test_near_copies_are_searched_by_simhash(spark):
    """The places of a set are bits of its SimHash fingerprint, counted here bit by bit; pairs at a similarity of
    just 0.8 are candidates, in crowded places as well."""
    rng = random.Random(13)
    rows = []
    for i in range(60):
        text = words(rng, 94).split()
        rows += [(2 * i, " ".join(text), "en", "a", 1), (2 * i + 1, " ".join([*text[:40], "new", *text[41:80], "word", *text[81:]]), "en", "a", 1)]
    found = resemblance.sketches(spark.createDataFrame(rows, DOC_SCHEMA))
    for r in found.collect():
        text = dict((d, t) for d, t, *_ in rows)[r.doc_id].split()
        hashes = [xxhash.xxh64_intdigest(" ".join(text[i : i + 5]), 42) for i in range(90)]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 90)
        assert r["keys"][:5] == [t << 12 | bits >> 12 * t & 4095 for t in range(5)]
    sets = resemblance.distinct_sets(found)
    fp = {r.doc_id: r.fp for r in found.collect()}
    for crowd in (4096, 1):
        held = {}
        for r in resemblance.shared_places(sets, crowd=crowd).collect():
            held.setdefault(r.place, set()).add(r.fp)
        assert all(any({fp[2 * i], fp[2 * i + 1]} <= h for h in held.values()) for i in range(60))


def test_places_that_overlap_are_one_group(spark):
    """Texts that are all somewhat alike meet in many tables; each is listed once in what is left to compare, not once
    for each place, and every two that share an open place are still in one group."""
    rng = random.Random(14)
    base, texts = words(rng, 150).split(), []
    for i in range(150):
        own = [*base]
        for at in rng.sample(range(150), 3 + i % 6):
            own[at] = f"w{i}x{at}"
        texts.append(" ".join(own))
    texts += [words(rng, 150) for _ in range(10)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC_SCHEMA)
    sets = resemblance.distinct_sets(resemblance.sketches(frame))
    places = resemblance.shared_places(sets)
    stars = resemblance.best_hubs(places)
    edges = resemblance.verified_stars(frame, sets, stars)
    before = resemblance.open_places(places, simhash.components(edges)).collect()
    groups = simhash.open_groups(places, stars, edges).collect()
    nodes = {r.node for r in before}
    assert len(before) > 20 * len(nodes) and len(groups) < 2 * len(nodes)
    held, met = {}, {}
    for r in groups:
        held.setdefault(r.root, set()).add(r.node)
    for r in before:
        met.setdefault(r.root, set()).add(r.node)
    assert all(any(m <= h for h in held.values()) for m in met.values())
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == dict(enumerate(brute_near_copies(rows)))


def test_groups_that_cost_more_as_one_stay_apart(spark):
    """A chain of places, each sharing a set with the next: all of them as one would be far more pairs."""
    rows = [(p, 1000 * p, fp) for p in range(300) for fp in range(1000 * p, 1000 * p + 1001, 100)]
    places = spark.createDataFrame(rows, "place long, a long, fp long")
    edges = spark.createDataFrame([(1, 2)], "a long, b long").limit(0)
    stars = resemblance.best_hubs(places)
    got = {}
    for r in simhash.open_groups(places, stars, edges, crowd=16).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(1000 * p, 1000 * p + 1001, 100)) for p in range(300)]
    one = simhash.open_groups(places.where("place < 2"), stars.where("a < 2000"), edges).collect()
    assert sorted(r.node for r in one) == list(range(0, 2001, 100)) and len({r.root for r in one}) == 1
