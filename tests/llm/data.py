"""Small inputs for the tests of this folder."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def awkward_rows():
    rng = random.Random(3)
    passage, long = words(rng, 80), words(rng, 20_000)
    texts = [None, "", "   \n\t ", "one", "two words", passage, passage, passage.upper(), words(rng, 30) + " " + passage, passage + " " + words(rng, 30), long, long + " tail", "a" * 5000, "ab" * 400, "é" * 300 + " " + passage, (words(rng, 12) + "\n") * 40]
    texts += [passage.replace(passage.split()[i], "zzz", 1) for i in (3, 17, 40)]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, passage, None, None, None), (None, words(rng, 50), "en", "a", 9), (5, passage, "en", "b", 1), (5, words(rng, 40), "en", "b", 1), (-7, texts[8], "fr", "", 0)]
    return rows


def awkward_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(awkward_rows(), DOC_SCHEMA)
    return frame.withColumns({c: F.lit(1) for c in ("fp", "size", "taken", "n_hit", "score", "component_id", "spans", "key", "sum", "a", "b", "_own_0")})
