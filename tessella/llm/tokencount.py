"""Count-only Viterbi: how many pieces a unigram tokenizer cuts a text into.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming
keeps the best score up to each character, and with it only the number of pieces. The rules are those
of the usual unigram encoder: starts are tried in order and a later one wins only with a higher score,
so ties go to the longer last piece; a character without a piece of its own can be an unknown one, 10
below the lowest score; a run of unknown characters is one piece, or, with byte fallback, one for each
of its bytes.

A text is a space mark and then its characters, each space as a mark; a leading space is kept, so the
text then starts with two. Texts are cut into units where no piece can reach over: before a run of
marks, which so stays whole and with the word after it, as there are pieces of several marks. That is
right if no piece has a mark after another character and the mark is a piece itself (so that no unknown
run goes over the cut); for other vocabularies a text is one unit. Each distinct unit is counted once
per task; the memory of units is emptied when it is full.

The vocabulary comes from a sentencepiece model file, whose path is a parameter; driver and tasks
share it as a broadcast of bounded size (it is no corpus data). Its normal and user-defined pieces are
matched; control, unknown, unused and byte pieces are never found in a text (bytes serve the fallback).

Cases: null and empty texts have 0 pieces; runs of spaces, leading and trailing ones, and the mark
character in a text are marks like others; very long units are counted but not remembered;
repeated rows and null doc_ids are counted one by one; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessella.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces that occur in texts, with scores, and whether unknown characters fall back to bytes."""

    pieces: list[tuple[str, float]]
    fallback: bool


def vocabulary(model_file: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in ids if not special(i)], sum(map(model.is_byte, ids)) == 256)


#: A run of marks with what follows up to the next mark.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Counter(dict):
    """Pieces of a unit, remembered for up to ``most`` of them."""

    def __init__(self, own: Vocabulary, most: int = 300_000, prefix: bool = True) -> None:
        self.prefix = prefix
        spans = any(SPACE in piece.lstrip(SPACE) for piece, _ in own.pieces)
        self.units = not spans and any(piece == SPACE for piece, _ in own.pieces)
        self.most = most
        self.finder = ahocorasick.Automaton()
        for piece, score in own.pieces:
            if piece:
                self.finder.add_word(piece, (len(piece), score))
        self.finder.make_automaton()
        self.unknown = min((s for _, s in own.pieces), default=0.0) - PENALTY
        self.bytes = own.fallback

    def cut(self, word: str) -> int:
        n, unknown = len(word), self.unknown
        best, count, in_run = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        end, at, top, alone = 0, 1, 0.0, True  # of the end being filled: best last piece, score
        # The automaton gives the pieces of one end together and the longest first, i.e. early
        # starts first; (n, ...) closes the last end.
        for last, (size, score) in chain(self.finder.iter(word), ((n, (0, 0.0)),)):
            if last + 1 != end:
                while True:
                    if not alone and (at == 0 or best[end - 1] + unknown > top):
                        top, at = best[end - 1] + unknown, 0
                        if self.bytes:
                            count[end] = count[end - 1] + len(word[end - 1].encode())
                        else:
                            count[end], in_run[end] = count[end - 1] + 1 - in_run[end - 1], 1
                        best[end] = top
                    elif end:
                        best[end], count[end] = top, count[end - at] + 1
                    end, at, alone = end + 1, 0, False
                    if end > last:
                        break
            if size:
                total = best[end - size] + score
                if at == 0 or total > top:
                    top, at = total, size
                if size == 1:
                    alone = True
        return count[n]

    def __missing__(self, unit: str) -> int:
        n = self.cut(unit)
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[unit] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, UNIT.findall(text))) if self.units else self.cut(text)


def count_tokens(docs: DataFrame, *, model_file: str = MODEL, prefix: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_chars) for every document; ``prefix``: whether a text starts with a mark of its own."""
    own = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(own.value, prefix=prefix)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = batch["text"].to_pylist()
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([counter.of(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
