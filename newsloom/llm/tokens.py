"""Token counts of a piece vocabulary with a shortcut for words that are one token.

The piece model joins neighbours by score wherever they stand, so a text may be cut at any place that no
piece crosses: before a run of spaces and around a line feed. ``prove_cuts`` checks that on the vocabulary
file, once per worker. Every piece that the library gives back as a single token when it stands alone
enters a table; words in the table count one without being tokenized. Only the rest is merged by the
library, once per distinct word and worker.

Null and empty texts have no tokens. Rows are independent: repeated rows repeat their counts, an empty table
gives an empty one, extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.columns import batches, texts

MARK = "▁"
#: A run of spaces with the word behind it, or a line feed with what follows it.
PRE_TOKEN = re.compile(rb" +[^ \n]*|\n[^ \n]*")
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_cuts(pieces: list[str]) -> None:
    """Raise unless no piece reaches over a cut."""
    for piece in pieces:
        if re.search(f"[^{MARK}]{MARK}", piece) or " " in piece or "\n" in piece:
            raise ValueError(f"a text can't be cut at spaces and line feeds: {piece!r} crosses them")


class WordCounts(dict):
    """Tokens of each pre-token as it stands inside a text."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.library.get_piece_size())
        pieces = [self.library.id_to_piece(i) for i in ids if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        prove_cuts(pieces)
        self.whole = {p.replace(MARK, " ").encode() for p in pieces if p.startswith(MARK)}
        self.whole = {w for w in self.whole if PRE_TOKEN.fullmatch(w) and self.merged(w) == 1}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def merged(self, word: bytes) -> int:
        """What the library makes of one pre-token; it puts a space of its own before any text."""
        if word == b" ":
            return 1
        if word[:1] == b" ":
            return len(self.library.encode(word[1:].decode()))
        return len(self.library.encode(word.decode())) - 1

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.merged(word)
        return n

    def of(self, text: bytes) -> int:
        if not text:
            return 0
        if len(self) > REMEMBERED:
            self.forget()
        return sum(map(self.__getitem__, PRE_TOKEN.findall(b" " + text.replace(MARK.encode(), b" "))))


@cache
def word_counts(model: str) -> WordCounts:
    return WordCounts(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    ``model`` is the path of a sentencepiece file that every executor can open.
    """

    def count(batch: pa.RecordBatch) -> dict:
        counts, found = word_counts(model), texts(batch)
        tokens = [counts.of(t) for t in found]
        return {"doc_id": batch.column(0), "n_bytes": [len(t) for t in found], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return docs.select("doc_id", "text").mapInArrow(batches(count, SCHEMA), SCHEMA)
