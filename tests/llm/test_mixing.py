import re
from collections import defaultdict

from pyspark.sql import functions as F
from tessella.llm import mixing
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents


def targets(sizes):
    """By resharing the excess until no target is above three times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, open_sources = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] > 3 * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}
        open_sources -= over


def check(frame, **options):
    out = mixing.mix(frame, **options).collect()
    rows = frame.collect()
    assert len(out) == len(rows)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r.doc_id), size_of(r.text)) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size_of(r.text)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        epochs = int(r.target + 0.5) // r.source_size if r.source_size else 0
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    return out


def test_real_documents(spark):
    first, again = (sorted(map(str, check(documents(spark), buckets=b))) for b in (1024, 3))
    assert first == again


def test_awkward_documents(spark):
    check(awkward_documents(spark))


def test_one_source_with_one_document(spark):
    rows = [(1, "a b c", "en", "s", 1), (2, "x " * 1000, "en", "t", 1), (3, "y", "en", "u", 1), (4, None, "en", "empty", 0)]
    check(spark.createDataFrame(rows, DOC_SCHEMA))


def test_heavier_documents_are_taken_more_often(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).alias("n_chars"))
    out = mixing.mix(frame, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 's0'").collect()
    even, odd = (sum(r.taken for r in out if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 1.8 * odd


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_null_and_equal_ids_do_not_share_a_bucket(spark):
    ids = {"null": F.lit(None).cast("long"), "one": F.lit(7).cast("long")}
    frame = spark.range(5000).select(ids["null"].alias("doc_id"), F.concat(F.lit("w "), F.col("id") % 4000).alias("text"), F.lit("s").alias("source"))
    frame = frame.unionByName(spark.range(3000).select(ids["one"].alias("doc_id"), F.lit("same row").alias("text"), F.lit("s").alias("source")))
    frame = frame.unionByName(spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("t").alias("source")))
    keys, repeated = mixing._keyed_rows(frame, F.lit(1.0), "", 1024)
    assert repeated.count() == 1001 and keys.count() == 10_000
    assert keys.select("h", "number").distinct().count() == 10_000
    assert keys.groupBy("source", "bucket").count().agg(F.max("count")).first()[0] < 40
    out, again = (sorted(map(str, mixing.mix(frame.repartition(n)).collect())) for n in (3, 7))
    assert out == again
    taken = mixing.mix(frame).where("doc_id = 7").agg(F.count_if(F.expr("taken % size = 0 AND taken > 0")), F.count_if(F.expr("taken = 0"))).first()
    assert min(taken) > 300  # about half of the equal rows are taken


def copies_of(frame):
    found = mixing.mixed_documents(frame)
    assert found.where(mixing.word_count(F.col("text")) != F.col("words")).count() == 0
    words = found.groupBy("source", "doc_id").agg(F.sum("words").alias("w")).collect()
    own = mixing.mix(frame).groupBy("source", "doc_id").agg(F.sum("taken").alias("t")).where("t > 0").collect()
    assert sorted(map(str, map(tuple, words))) == sorted(map(str, map(tuple, own)))
    whole = {(r.doc_id, r.text) for r in frame.collect()}
    assert all((r.doc_id, r.text) in whole for r in found.where("words = size").collect())


def test_mixed_documents(spark):
    copies_of(documents(spark))
    copies_of(awkward_documents(spark))
    assert mixing.mixed_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
