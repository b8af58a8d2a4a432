import hashlib
import re

import pytest
from tessella.llm import decontam
from tests.llm.data import DOC_SCHEMA, SF, awkward_documents, documents

BENCH = "item_id long, text string, n_hit int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        words = split(text)
        hit, named = set(), set()
        for item_id, item in items:
            own = split(item)
            size = min(n, len(own))
            for w in range(len(own) - size + 1) if size else ():
                for i in range(len(words) - size + 1):
                    if words[i] == own[w] and words[i : i + size] == own[w : w + size]:
                        hit |= set(range(i, i + size))
                        named.add(str(item_id))
        out.append(str((doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


def items(spark):
    rows = awkward_documents(spark).select("doc_id", "text").collect()
    long = rows[5].text.split()
    return [(1, " ".join(long[20:45])), (2, " ".join(long[20:45]).upper() + "!"), (10, "two words"), (11, ""), (12, None), (13, "one"), (14, " ".join(long[:11])), (15, "é, é; É"), (3, "... ---")]


@pytest.mark.parametrize("block_bytes", [16 << 20, 150])
def test_awkward_documents(spark, block_bytes):
    frame = awkward_documents(spark)
    found = items(spark)
    bench = spark.createDataFrame([(i, t, 7) for i, t in found], BENCH)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = decontam.report(frame, bench, block_bytes=block_bytes).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, found)


def test_removal(spark):
    frame, bench = awkward_documents(spark), spark.createDataFrame([(i, t, 7) for i, t in items(spark)], BENCH)
    report = decontam.report(frame, bench)
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns and kept.count() == report.where("NOT contaminated").count()
    cut = decontam.decontaminate(frame, bench, remove="spans")
    assert cut.columns == frame.columns and cut.count() == frame.count()
    words = sum(len(split(r.text)) for r in cut.collect())
    assert words == sum(r.n_words - r.n_hit for r in report.collect())


def test_real_documents(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontam.report(documents(spark), bench).collect()
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(str(tuple(r)) for r in got) == brute(rows, [(r.item_id, r.text) for r in bench.collect()])


def test_index_is_small(spark):
    """Under 8 bytes a byte of text on the given items, and never above what blocks are planned with."""
    items = [(r.item_id, decontam.words_of((r.text or "").encode())) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    raw = sum(len(w) + 1 for _, words in items for w in words)
    many = [(i, [(w + b"%d" % j if j else w) for w in words]) for i, words in items for j in range(20)]
    assert decontam.NgramIndex([(i, w) for i, words in items for w in [words] * 40], 10).size() < 8 * 40 * raw
    assert decontam.NgramIndex(many, 10).size() < decontam.WORD_BYTES * sum(len(w) for _, w in many)
    long = [(0, [b"%d" % i for i in range(50_000)])]
    assert decontam.NgramIndex(long, 10).size() < decontam.WORD_BYTES * 50_000


def test_long_items_go_by_pieces(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000)), 0)], BENCH)
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 3000), (395, 425), (2990, 3000), (2991, 3000), (399, 409))]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOC_SCHEMA)
    pieces = decontam._pieces(bench, 10, 400)
    assert pieces.count() == 8
    got = decontam.report(docs, bench, block_bytes=400 * 16 * decontam.WORD_BYTES // 16)
    assert sorted((r.doc_id, r.n_hit) for r in got.collect()) == [(0, 3000), (1, 30), (2, 10), (3, 0), (4, 10)]


def test_decontaminate_empty(spark):
    empty = spark.createDataFrame([], BENCH)
    assert decontam.decontaminate(spark.createDataFrame([], DOC_SCHEMA), empty).count() == 0
    assert decontam.decontaminate(documents(spark), empty).count() == documents(spark).count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], BENCH)
    assert decontam.report(documents(spark), empty).where("contaminated").count() == 0
    assert decontam.report(spark.createDataFrame([], DOC_SCHEMA), empty).count() == 0
