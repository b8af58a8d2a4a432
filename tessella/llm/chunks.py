"""Exact dedup by content-defined chunk recipes, DataFrame functions only.

A text, without its white space, is cut into chunks at places that its characters choose: after two
marked characters in a row, once a chunk has ``least`` characters, and after ``most`` in any case.
Equal texts have equal chunks. A chunk's identifier is its 128-bit hash, which is verified: the
distinct (hash, chunk) pairs of all texts are formed, combined in the tasks first, and where two
chunks share a hash their places among these tell them apart. A document's recipe is the ordered list of
its chunks' identifiers. Recipes are compared whole, and get verified identifiers in the same manner.

So each chunk moves once for each task that holds it, and nothing but identifiers moves after that: a
long or much copied text is never shuffled as a whole. Rows meet their group by the recipe's identifier;
recipes with more than a thousandth of all rows are broadcast (16 bytes each), so none of them is one
task. Of equal texts the row with the most code points in the original text stays, then the one with the
smallest doc_id (null last), then any one of them.

Cases: null text counts as empty; empty and blank texts are equal to each other; rows with null or
repeated doc_ids are rows of their own, and exactly one row of each group stays; very long texts are
cut like others; an empty table gives an empty result; further columns are ignored by ``groups`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import join_counted, materialize

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ID = ["a", "b", "place"]
KEY = ["r", "s", "other"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends with two marked characters: every fifth of ASCII, and marks that close sentences elsewhere."""
    marked = "".join(f"\\x{c:02X}" for c in range(0x21, 0x7F) if c % 5 == 0) + "。！？؟।"
    return f"(?s).{{{least - 2},{most - 2}}}?[{marked}][{marked}]|.{{1,{most}}}"


def _hashes(content: Column, bits: int) -> list[Column]:
    """Two hashes; fewer ``bits`` than 64 serve tests of what happens when they collide."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(salt), content), 64 - bits) for salt in (1, 2)]


def _cut(docs: DataFrame, least: int, most: int) -> Column:
    return F.regexp_extract_all(normalised(F.col("text")), F.lit(chunk_pattern(least, most)), F.lit(0))


def _told_apart(distinct: DataFrame, content: str, names: list[str]) -> DataFrame | None:
    """(first hash, second hash, content, place) of the contents that share both hashes with another one, numbered
    from 1; None if there are none. ``distinct``: all (hash, hash, content)."""
    first, second, place = names
    shared = materialize(distinct.groupBy(first, second).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "shared")
    if not shared.head(1):
        return None
    number = F.row_number().over(Window.partitionBy(first, second).orderBy(content))
    return materialize(distinct.join(shared, [first, second], "left_semi").withColumn(place, number.cast("long")), "told-apart")


def _numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` with a number for each row, as a written table: a row keeps its number when tasks are repeated."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "numbered")


def _recipes(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """(row, doc_id, size, text_sha256, recipe): a written table. The recipe has three numbers for each chunk, the
    last one 0 but for chunks whose hash is not theirs alone. ``docs`` may have ``row`` numbers already."""
    a, b = _hashes(F.col("chunk"), bits)
    distinct = docs.select(F.explode(_cut(docs, least, most)).alias("chunk")).select(a.alias("a"), b.alias("b"), "chunk").distinct()
    apart = _told_apart(distinct, "chunk", ID)
    named = F.transform(_cut(docs, least, most), lambda c: F.array(*_hashes(c, bits), F.lit(0).cast("long")))
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    columns = ["doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), digest.alias("text_sha256"), F.flatten(named).alias("recipe")]
    if apart is None:
        return materialize(docs.select("row", *columns), "recipes") if "row" in docs.columns else _numbered(docs, *columns)
    # Recipes with such chunks are put together again.
    docs = docs if "row" in docs.columns else _numbered(docs, "doc_id", "text")
    own = docs.select("row", F.posexplode(_cut(docs, least, most)).alias("pos", "chunk")).withColumns({"a": a, "b": b})
    placed = materialize(own.join(apart, ["a", "b", "chunk"], "left").drop("chunk"), "placed")
    part = F.struct("pos", F.array("a", "b", F.coalesce("place", F.lit(0).cast("long"))).alias("id"))
    touched = placed.where("place IS NOT NULL").select("row").distinct()
    again = placed.join(touched, "row", "left_semi").groupBy("row").agg(F.flatten(F.sort_array(F.collect_list(part)).getField("id")).alias("_recipe"))
    rows = docs.select("row", *columns).join(again, "row", "left")
    return materialize(rows.withColumn("recipe", F.coalesce("_recipe", "recipe")).drop("_recipe"), "recipes")


def _groups(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """(row, doc_id, text_sha256, keep_row, keep_id, group_size) for every row of ``docs`` (doc_id, text, and
    ``row`` if they are numbered)."""
    rows = _recipes(docs, least, most, bits)
    r, s = _hashes(F.col("recipe"), bits)
    rows = rows.withColumns({"r": r, "s": s})
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    found = materialize(rows.groupBy("r", "s", "recipe").agg(best, F.count("*").alias("n")), "recipe-groups")
    apart = _told_apart(found.select("r", "s", "recipe"), "recipe", KEY)
    if apart is None:
        rows, found = (df.drop("recipe").withColumn("other", F.lit(0).cast("long")) for df in (rows, found))
    else:
        known = lambda df: df.join(apart, ["r", "s", "recipe"], "left").withColumn("other", F.coalesce("other", F.lit(0).cast("long"))).drop("recipe")
        rows, found = known(rows), known(found)
    rows, found = materialize(rows.drop("size"), "keyed"), materialize(found, "keyed-groups")
    out = join_counted(rows, found, KEY)
    return out.select("row", "doc_id", "text_sha256", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def groups(docs: DataFrame, *, least: int = 256, most: int = 4096, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    out = _groups(docs.select("doc_id", "text"), least, most, bits)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, least: int = 256, most: int = 4096, bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    whole = _numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    out = _groups(whole.select("row", F.col("all.doc_id"), F.col("all.text")), least, most, bits)
    kept = out.where(F.col("row") == F.col("keep_row")).select("row")
    return whole.join(kept, "row", "left_semi").select("all.*")
