"""Each stage against what its operator says of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from tessella.llm import decontam, mixing, quality, simhash, substrings
from tessella.llm.common import materialize, read
from tests.llm.data import awkward_documents

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DIR, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, DIR), "test")
        if i < 4:
            assert out.columns == columns and out.count() > 0
        kept[i] = (docs, out)
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept[0]
    assert ids(after) == ids(quality.score(before).where("keep"))
    before, after = kept[1]
    assert ids(after) == ids(simhash.near_duplicates(before).where("doc_id = component_id"))
    before, after = kept[2]
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.report(before).collect()}
    sizes = {r.doc_id: r.n for r in after.select("doc_id", F.octet_length("text").alias("n")).collect()}
    assert all(removed[d][0] - removed[d][1] <= n <= removed[d][0] - removed[d][1] + 6 * 3 for d, n in sizes.items())
    assert all(b - r <= 40 for d, (b, r) in removed.items() if d not in sizes)
    before, after = kept[3]
    assert ids(after) == ids(decontam.report(before, read(spark, DIR, "benchmark")).where("NOT contaminated"))
    before, after = kept[4]
    assert sorted(map(str, after.collect())) == sorted(map(str, mixing.mixed_documents(before).collect()))


def test_run_equals_its_stages_and_reruns_agree(spark):
    first, again = (sorted(map(str, corpus_pipeline.run(spark, DIR).collect())) for _ in range(2))
    assert first and first == again


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, each stage on its own
    input; then an empty table through all of them."""
    frame = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    out = {name: stage(spark, frame, DIR) for name, stage in corpus_pipeline.STAGES}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(out[n].columns == frame.columns for n in names[:4])
    texts = {n: sorted(str((r.doc_id, r.text)) for r in out[n].collect()) for n in names}
    plain = sorted(map(str, rows))
    assert all((t or "").split() for r in out[names[0]].collect() for t in [r.text])
    assert set(texts[names[0]]) <= set(plain)
    kept = out[names[1]].collect()
    assert set(texts[names[1]]) <= set(plain) and len({(r.text or "").lower() for r in kept}) == len(kept)
    assert {(r.text or "").lower().strip() for r in kept} >= {"", "one", "two words"}
    assert {r.doc_id for r in out[names[2]].collect() if r.text is None} == {0}
    assert texts[names[3]] == plain
    mixed = out[names[4]].collect()
    assert mixed and all(0 < r.words <= r.size and len(r.text.split()) == r.words for r in mixed)
    docs = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), "empty")
        assert docs.count() == 0
