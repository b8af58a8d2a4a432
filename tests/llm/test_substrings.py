import hashlib
import random
from collections import Counter

from tessella.llm import substrings
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents, words


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(map(str, out))


def check(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert sorted(str(tuple(r)) for r in substrings.report(frame).collect()) == brute(rows)


def test_real_documents_match_brute_force(spark):
    check(documents(spark))


def test_awkward_documents(spark):
    check(awkward_documents(spark))


def test_shifted_overlaps(spark):
    rng = random.Random(8)
    base = words(rng, 400)
    rows = [(i, words(rng, 5) + base[a : a + n] + words(rng, 5)) for i, (a, n) in enumerate((rng.randrange(1500), rng.randrange(150, 420)) for _ in range(60))]
    rows += [(100, base[:199]), (101, base[:200]), (102, base[1:201]), (103, base[300:500] + base[300:500])]
    check(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOC_SCHEMA))


def test_first_identifiers_that_collide(spark):
    """Three bits of the first identifier: all buckets hold different strings, none is taken for a repeat."""
    frame = documents(spark)
    spans = lambda **o: {(r.k, r.s): sorted(substrings.merged([(x.start, x.end) for x in r.spans], 1 << 40)) for r in substrings.repeats(frame, **o).collect()}
    assert spans(bits=3) == spans() != {}


def test_one_line_in_most_documents(spark):
    """A passage that nearly every row holds, at many places: its keys are dealt with by themselves."""
    rng = random.Random(6)
    line = words(rng, 60)
    check(spark.createDataFrame([(i, (line + "\n") * (1 + i % 4) + words(rng, 40), "", "", 0) for i in range(300)], DOC_SCHEMA))


def test_text_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    text = words(random.Random(4), 800).encode()
    pieces = substrings.anchors_of(text, 200)
    monkeypatch.undo()
    whole = substrings.anchors_of(text, 200)
    assert all((a == b).all() for a, b in zip(pieces, whole))


def test_empty_table(spark):
    assert substrings.report(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_remove_repeats_keeps_other_columns(spark):
    frame = awkward_documents(spark)
    out = substrings.remove_repeats(frame)
    assert out.columns == frame.columns
    texts = [r.text for r in out.collect()]
    assert all("�" not in (t or "") for t in texts)
