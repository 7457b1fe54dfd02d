"""Operator 2: token counts of whole texts under a public tokenizer.

The whole-token shortcut. A text falls into pre-tokens at places that no merge can cross; for most of them one look-up
tells the count. What makes that exact is proved on the vocabulary before any text is read (`Counter._prove`):

* no piece holds a space mark after another character, so a run of spaces and the word after it merge among themselves;
* no piece holds a line feed beside another character, so a line feed is a token of its own and separates the rest;
* the normaliser changes nothing (the model has no character map; checked on every piece).

Texts that hold the space mark itself are left to the library.

Pieces which the library encodes alone as one token are counted by look-up; other pre-tokens are merged by the library
and their counts remembered in a table of bounded size. Where the proof fails, and for other tokenizer files, the library
counts whole texts. The result is the library's own in either case.

Nulls count as empty texts; empty texts have 0 tokens; texts of any length are read whole; repeated rows and null ids are
counted as any row; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship
from .words import rows

_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
_MARK = "▁"


def _fields(message: bytes):
    """(number, value) of a serialised message's fields; the value of a fixed-width one is not needed and left out."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, message[at : at + size]
            at += size
        else:
            at += {1: 8, 5: 4}[kind]


def _character_map(model: bytes) -> bool:
    """Whether the normaliser replaces characters: field 2 of the model's field 3 has its map."""
    return any(n == 2 and value for number, spec in _fields(model) if number == 3 for n, value in _fields(spec))


class Counter:
    """Counts of one tokenizer file.

    `table` has the pre-tokens proved to be one token; `learned` has them and those merged so far, up to `remember`
    and what a single batch brings.
    """

    def __init__(self, path: str, remember: int = 400_000):
        self.path, self.remember, self.learned = path, remember, {}
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.exact = self._prove()
        else:
            from tokenizers import Tokenizer

            self.tk, self.exact = Tokenizer.from_file(path), False

    def _prove(self) -> bool:
        """Whether pre-tokens merge independently; fills in those that are one token."""
        sp, pieces = self.sp, []
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if _MARK in piece.lstrip(_MARK) or "\n" in piece or sp.is_control(i):
                return False
            pieces.append(piece)
        model = sp.serialized_model_proto()
        if _character_map(model) or sp.normalize("é  ﬁ x ") != f"{_MARK}é{_MARK}{_MARK}ﬁ{_MARK}x{_MARK}":
            return False
        if len(sp.encode("a\n\nb")) != len(sp.encode("a")) + 2 + self._bare("b"):
            return False
        self.feed = sp.encode("\n")[-1]
        texts = [t for p in pieces if _PRE_TOKEN.fullmatch(t := p.replace(_MARK, " "))]
        self.table = {t: 1 for t, n in zip(texts, self._merge(texts), strict=True) if n == 1} | {"\n": self._bare("\n")}
        self.learned = dict(self.table)
        return sp.normalize("".join(pieces).replace(_MARK, " ")) == _MARK + "".join(pieces)

    def _bare(self, text: str) -> int:
        """Tokens of a text as it stands behind a line feed, without the space that the library puts before texts."""
        return len(self.sp.encode("\n" + text)) - len(self.sp.encode("\n"))

    def _merge(self, texts: list[str]) -> list[int]:
        """Counts of pre-tokens: many to a call, with line feeds between them, which are tokens of their own."""
        counts = []
        for i in range(0, len(texts), 500):
            ids = np.array(self.sp.encode("\n" + "\n".join(texts[i : i + 500])))
            counts += (np.diff(np.flatnonzero(ids == self.feed), append=len(ids)) - 1).tolist()
        return counts

    def count(self, texts: list[str]) -> list[int]:
        if not self.exact:
            if self.path.endswith(".model"):
                return [len(x) for x in self.sp.encode(texts, num_threads=1)]
            return [len(x.ids) for x in self.tk.encode_batch(texts, add_special_tokens=False)]
        cut = [[] if not t or _MARK in t else _PRE_TOKEN.findall(" " + t) for t in texts]
        new = list(set().union(*cut).difference(self.learned))
        if len(self.learned) + len(new) > self.remember:
            self.learned = dict(self.table)
            new = list(set().union(*cut).difference(self.learned))
        self.learned.update(zip(new, self._merge(new), strict=True))
        look = self.learned.__getitem__
        return [len(self.sp.encode(t)) if t and _MARK in t else sum(map(look, c)) for t, c in zip(texts, cut, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row; `tokenizer` is a path every executor has."""
    ship(docs.sparkSession)

    def count(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(tokenizer)
            for part in rows(batch, "t"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
