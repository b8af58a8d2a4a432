import random

import pytest
import sentencepiece
from tessella.llm import tokencount
from tests.llm.data import DOC_SCHEMA, awkward_documents, documents
from tokenizers import Tokenizer, models

CODE = "def f(x):\n    if x:\n        return  {'a':   1}\n\n\tx = [\t1,  2]   # two\n"


class Encoder:
    """The unigram encoder of an independent library on the same pieces and the whole text at once, its byte and
    unknown pieces under names that no text has."""

    def __init__(self, own):
        pieces = [("\ue000unk", 0.0)] + ([(f"<0x{b:02X}>", 0.0) for b in range(256)] if own.fallback else []) + own.pieces
        self.tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=own.fallback))

    def count(self, text, prefix=True):
        return len(self.tokenizer.encode(("▁" if prefix else "") + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def spaced():
    """Runs of 1 to 40 spaces, at every place, with tabs, marks and indented code."""
    rng = random.Random(8)
    texts = [" a  b", "x    y", "one        two", " ", "  ", "   a", "a   ", "▁", "a▁▁b", " ▁a", CODE, CODE * 20, "\t\t x", "a\t b"]
    texts += ["".join(rng.choice(["word", "x", "été", "漢", "\n", "\t", "()", "▁"]) + " " * rng.choice([0, 1, 1, 2, 3, 4, 7, 8, 16, 17, 40]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    return [" " * n + t for n in (0, 1, 2, 5) for t in texts] + [" " * n for n in range(1, 41)]


def test_documents_match_the_encoder(spark):
    encoder = Encoder(tokencount.vocabulary())
    for frame in (documents(spark), awkward_documents(spark), spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(spaced())], DOC_SCHEMA)):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = sorted((str(r.doc_id), r.n_tokens) for r in tokencount.count_tokens(frame).collect())
        assert got == sorted((str(d), encoder.count(t)) for d, t in rows)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("kind", ["runs", "inner", "no mark"])
def test_ties_and_unknown_characters(fallback, kind):
    """Random vocabularies: with pieces of several marks, with marks inside of pieces, and without the mark."""
    rng = random.Random(2)
    for _ in range(6):
        made = {"".join(rng.choice("ab▁▁c") for _ in range(rng.randrange(1, 6))) for _ in range(60)} - {"c", "▁"}
        if kind != "inner":
            made = {p for p in made if "▁" not in p.lstrip("▁")} | {"▁" * n for n in (2, 3, 5)}
        if kind != "no mark":
            made |= {"▁"}
        own = tokencount.Vocabulary([(p, -float(rng.randrange(3))) for p in sorted(made)], fallback)
        encoder = Encoder(own)
        for prefix in (True, False):
            counter = tokencount.Counter(own, most=50, prefix=prefix)
            assert counter.units == (kind == "runs")
            for _ in range(500):
                text = "".join(rng.choice("abbaac é漢\n  ▁") * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randrange(1, 25)))
                assert counter.of(text) == encoder.count(text, prefix), repr(text)


def test_the_file_s_own_encoder_keeps_spaces():
    """It merges in another order, so only texts with one way to be cut have the same counts."""
    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.MODEL)
    counter = tokencount.Counter(tokencount.vocabulary())
    for text in (" a b", " a", "a ", "  ", "    ", "a    b"):
        assert counter.of(text) == len(model.encode(text)), text


def test_control_and_byte_pieces_are_text(spark):
    """As the model file's own encoder has it, which never finds them in a text."""
    own = tokencount.vocabulary()
    counter, encoder = tokencount.Counter(own), Encoder(own)
    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.MODEL)
    assert own.fallback and not {"<s>", "</s>", "<unk>", "<0x0A>"} & {p for p, _ in own.pieces}
    for text in ("a<s>b", "</s>", "<unk> x", "<s><s>"):
        assert counter.of(text) == encoder.count(text)
        assert counter.of(text) > 1 and len(model.encode(text)) > 1
    assert counter.of("a<s>b") == len(model.encode("a<s>b")) == 5
    assert counter.of("<0x0A>") == len(model.encode("<0x0A>"))


def test_empty_table(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
