import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tessella.llm import chunks
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents, words


def brute(rows):
    """(doc_id, keep_id, group_size, digest), and how many rows of each group stay: one."""
    by = defaultdict(list)
    for doc_id, text in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for plain, own in by.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(d, keep[0], len(own), hashlib.sha256(plain.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=str), sorted((hashlib.sha256(p.encode()).hexdigest() for p in by))


def check(frame, **options):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = chunks.groups(frame, **options).collect()
    want, texts = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sorted(r.text_sha256 for r in got if r.kept) == texts
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def spaced_rows(spark):
    rng = random.Random(6)
    texts = [words(rng, 200) for _ in range(20)] + ["", None, " \t\n\x0b\x0c\r", " ", "a b", "ab", "漢字。！漢字" * 300, "😀" * 700]
    rows = []
    for i, t in enumerate(texts * 3):
        s = t if t is None or i < len(texts) else "".join(c + rng.choice(["", "", " ", "\n"]) for c in t)
        rows.append((rng.choice([i, None]), s, "en", "a", 1))
    return spark.createDataFrame(rows + rows[:9], DOC_SCHEMA)


@pytest.mark.parametrize("options", [{}, {"least": 8, "most": 64}, {"least": 8, "most": 64, "bits": 3}, {"bits": 1}])
def test_matches_brute_force(spark, options):
    """Also with hashes cut to a few bits, so that many chunks and recipes share one."""
    for frame in (documents(spark).limit(60), awkward_documents(spark), spaced_rows(spark)):
        check(frame, **options)


def test_chunks_make_up_the_text_and_follow_content(spark):
    rng = random.Random(7)
    text = words(rng, 3000)
    rows = spark.createDataFrame([(1, text, "en", "a", 1), (2, "some words before it " + text, "en", "a", 1), (3, "é漢" * 9000, "en", "a", 1)], DOC_SCHEMA)
    a, b, c = (r[0] for r in rows.orderBy("doc_id").select(chunks._cut(rows, 256, 4096)).collect())
    assert "".join(a) == text.replace(" ", "") and len(a) > 10
    assert max(map(len, a)) <= 4096 and min(map(len, a[:-1])) >= 256
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert "".join(c) == "é漢" * 9000 and max(map(len, c)) == 4096


def test_deduplicate_keeps_columns(spark):
    frame = awkward_documents(spark).withColumn("row", F.lit(1)).withColumn("all", F.lit(2))
    out = chunks.deduplicate(frame)
    assert out.columns == frame.columns
    kept = sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect())
    assert kept == sorted({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in frame.collect()})


def test_empty_table(spark):
    assert chunks.groups(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
