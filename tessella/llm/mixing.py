"""Mixing sources to target weights (Efraimidis-Spirakis sampling), DataFrame functions only.

Every document gets an exponential key scaled by its quality weight; within a source, documents are
taken in the order of their keys until the source's word budget is spent. A budget above the
source's own size first takes every document once per complete epoch.

No source is sorted as a whole. Keys fall into narrow logarithmic buckets, of which each holds at
most ``1 / (e * buckets)`` of its source whatever the weights are (k * exp(-k) <= 1 / e); sums per
(source, bucket) find the one bucket in which the budget ends, and only that bucket is ordered.

The key of a row comes from its doc_id, a digest of its text and its number among the rows that are
equal to it in doc_id, source and text, so null and repeated doc_ids have keys of their own. Rows are
numbered only where there are equal ones, in two steps over 1,024 parts of each group, so that no group
is one task; which of equal rows has which number does not change the result's rows.

Cases: null text has size 0 and is never taken; null source is a source of its own (last in order);
null and repeated doc_ids take part like any other; equal rows are separate documents with keys of
their own, ties between equal keys go by doc_id then size; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import join_counted, materialize

WORD = r"[^\x20\x09-\x0D]+"
MARKS = "!#$%&*|"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 as marks such as ``# $ % | !`` take up the text."""
    length = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 4.0 * marks / length), F.lit(0.1))


def exponential_key(doc_id: Column, digest: Column, number: Column, weight: Column, seed: str = "") -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits of md5, so that reruns agree."""
    own = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.lower(F.hex(digest)), F.lit("|"), number.cast("string"))
    u = (F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


PARTS = 1024


def _sized(docs: DataFrame, weight: Column, text: bool = False) -> DataFrame:
    """doc_id, source, size, weight, digest of the text and a hash of the row; ``text`` too if wanted."""
    held = [c for n in ("doc_id", "source", "text") for c in (F.col(n).isNull(), F.col(n))]
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), weight.alias("weight"), digest.alias("digest"), F.xxhash64(*held).alias("h"), *(["text"] if text else []))


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (a written table), which are those of the hashes in ``repeated``, with ``number``: 0, 1, ... for
    the rows of one hash."""
    rows = materialize(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "repeated-rows")
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("h", "part").agg(F.count("*").alias("n"))
    parts = materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    placed = join_counted(rows, parts, ["h", "part"])
    number = F.row_number().over(Window.partitionBy("h", "part").orderBy("size")) - 1 + F.col("before")
    return placed.withColumn("number", number).drop("n", "before", "part")


def _keyed(rows: DataFrame, seed: str, buckets: int) -> DataFrame:
    rows = rows.withColumn("key", exponential_key(F.col("doc_id"), F.col("digest"), F.col("number"), F.col("weight"), seed))
    return rows.withColumn("bucket", F.floor(F.log("key") * buckets)).drop("digest", "weight")


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """From (source, source_size): each source's target. Weights run 1..cycle by code point, null
    last, and share the sum of all sizes; no target is above ``most`` times its source's size.

    Resharing the excess by weight until none is above ends at ``min(cap, weight * level)``, with
    the level at which the targets use up the total: the largest, over sources sorted by cap per
    weight, of (total - caps before) / (weights from here on). The table has one row per source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    named = named.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything))
    return named.withColumn("level", level).select("source", "source_size", target.alias("target"))


def _plan(sized: DataFrame, buckets: int, cycle: int, most: int) -> DataFrame:
    """One row for each source (``of``): its size, target, complete epochs, the rest of the budget, and
    the bucket in which that ends, with the words of the buckets before."""
    per_bucket = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    budget = F.floor(F.col("target") + 0.5)
    plan = source_targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, most)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(budget / F.nullif("source_size", F.lit(0))), F.lit(0)))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))

    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0))).alias("b")
    ends = ends.join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    ends = ends.select(F.col("p.source").alias("at"), F.col("bucket").alias("edge"), "before")
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")
    return materialize(plan, "mix-plan").withColumnRenamed("source", "of")


def _taken(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows outside their source's last bucket, and those in it, both with ``taken``. Only the
    latter are ordered."""
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    whole = F.col("epochs") * F.col("size")
    inside = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    sure = rows.where(F.coalesce(F.col("bucket") != F.col("edge"), F.lit(True))).withColumn("taken", whole + F.when(inside, F.col("size")).otherwise(0))
    ordered = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    edge = rows.where(F.col("bucket") == F.col("edge")).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return sure, edge


def _keyed_rows(docs: DataFrame, weight: Column, seed: str, buckets: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with keys, without texts, and the hashes of those that have equals (None: none have)."""
    sized = materialize(_sized(docs, weight), "mix")
    repeated = materialize(sized.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if not repeated.head(1):
        return materialize(_keyed(sized.withColumn("number", F.lit(0)), seed, buckets), "mix-keys"), None
    known = join_counted(sized, repeated, ["h"], "left")
    alone = known.where("n IS NULL").drop("n").withColumn("number", F.lit(0))
    more = _numbered(known.where("n IS NOT NULL").drop("n"), repeated)
    return materialize(_keyed(alone.unionByName(more), seed, buckets), "mix-keys"), repeated


def mix(docs: DataFrame, *, weight: Column | None = None, buckets: int = 1024, seed: str = "", cycle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken``: words of the document in the mix, repeats counted: its size once per complete epoch,
    and once more if its key is within the rest of the budget. The document at the very edge gives
    only the words that still fit, so each source's sum is its target, rounded."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    keys, _ = _keyed_rows(docs, weight, seed, buckets)
    sure, edge = _taken(keys, _plan(keys, buckets, cycle, most))
    columns = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return sure.select(*columns).unionByName(edge.select(*columns))


def mixed_documents(docs: DataFrame, *, weight: Column | None = None, buckets: int = 1024, seed: str = "", cycle: int = 3, most: int = 3) -> DataFrame:
    """The mix itself, one row per copy of a document that is taken: (doc_id, source, size, source_size,
    target, taken, copy, words, text), where a copy that is taken in part has its first ``words`` words.

    The decision is made on rows without texts, as in ``mix``. Then the texts are read once more: whether
    a document is taken follows from its key and its source's plan, so texts stay where they are; only
    those of the bucket in which a budget ends, and of equal rows, are joined with their decision."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    keys, repeated = _keyed_rows(docs, weight, seed, buckets)
    plan = _plan(keys, buckets, cycle, most)
    decided = ["source_size", "target", F.col("taken").cast("long").alias("taken")]
    columns = ["doc_id", "source", "size", *decided, "text"]
    rows, more = _sized(docs, weight, text=True), None
    if repeated is not None:
        more = _numbered(rows.join(repeated, "h", "left_semi"), repeated)
        rows = rows.join(repeated, "h", "left_anti")
    rows = _keyed(rows.withColumn("number", F.lit(0)), seed, buckets)
    out = _taken(rows, plan)[0].select(*columns)
    sure, edge = _taken(keys, plan)
    decision = edge.select("h", "number", *decided)
    ends = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("edge"))).drop("source_size", "target")
    if more is not None:
        decision = decision.unionByName(sure.select("h", "number", *decided))
        ends = ends.select("doc_id", "source", "size", "h", "number", "text").unionByName(more.select("doc_id", "source", "size", "h", "number", "text"))
    out = out.unionByName(ends.join(decision, ["h", "number"]).select(*columns))

    copies = out.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    copies = copies.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    tokens = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(tokens, 1, F.col("words").cast("int")), " "))
    return copies.withColumn("text", text).select("doc_id", "source", "size", "source_size", "target", "taken", "copy", "words", "text")
