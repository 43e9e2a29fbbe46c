"""Packing token sequences into training sequences by vector best fit.

Each document becomes its token ids and the end id; documents longer than a sequence are cut into
pieces of its length. A piece demands tokens, one document place and attention cost (its length
squared, the cost of attention within a piece). Pieces are placed in decreasing length into the
open sequence that can take all three demands and

* leaves the smallest weighted norm of residual capacities (``rule="norm"``), or
* has the largest weighted dot product of residual capacities and demands (``rule="dot"``);

a new sequence is opened only if none can take the piece.

Only lengths are packed: texts are encoded once in the scan, and the rows of their pieces are dealt
at random into groups of about GROUP pieces, each packed by one task. So a task holds a bounded
number of short rows at any size of the corpus, and each group wastes at most part of a sequence.

Encoding: words between white space are encoded once per worker's memory and their ids joined. That
gives what the tokenizer gives for the whole text if it drops white space and no rule spans it,
as with the vocabulary used here; ``whole_words=False`` encodes whole texts instead.

Defined cases: a null text counts as empty and is the end id alone. Null or repeated ids and
repeated rows are packed like any row. An empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelsieve.llm.common import text_of, written
from modelsieve.llm.token_count import byte_alphabet

LENGTH = 2048
END = 0
GROUP = 20_000
CACHE = 400_000
WIDTH = 4

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Separators that str.split takes for white space and tokenizers do not.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and kind no Unicode version changes.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+")


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; remembers the ids of words.

    With ``whole_words`` a word of letters, alone or before one mark, is handed to the merges of the
    tokenizer directly, in lower case and in the stand-ins of its bytes. Any other word goes through
    the whole tokenizer.
    """

    def __init__(self, definition: str, whole_words: bool) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.whole_words = whole_words
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.stand_ins = {byte: sign for sign, byte in byte_alphabet().items()}

    def _merged(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of letters, None if it is not one for sure."""
        low = word.lower()
        found = self.letters.get(low)
        if found is None:
            if not low.isalpha() or not (low.isascii() or (_LATIN.fullmatch(low) and is_normalized("NFC", low))):
                return None
            signs = low if low.isascii() else low.encode().decode("latin-1").translate(self.stand_ins)
            found = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
            self.letters[low] = found
        return found

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of letters, alone or before one mark, None for any other."""
        if not word:
            return b""
        if word[-1] not in ".,;:!?":
            return self._letters(word)
        ids = self._letters(word[:-1])
        return None if ids is None else ids + self._mark(word[-1])

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._merged([mark])[0]
        return self.marks[mark]

    def ids(self, text: str) -> bytes:
        if not self.whole_words:
            return self._merged([text])[0]
        words = re.split(r"[ \t\r\n]+", text) if _NOT_WHITE.search(text) else text.split()
        others = []
        for word in set(words).difference(self.known):
            ids = self._word(word)
            if ids is None:
                others.append(word)
            else:
                self.known[word] = ids
        # One call for all of a text, as a call costs more than most words.
        if others:
            self.known.update(zip(others, self._merged(others), strict=True))
        ids = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > CACHE:
            self.known = {}
        if len(self.letters) > CACHE:
            self.letters = {}
        return ids


_encoders: dict[tuple[str, bool], Encoder] = {}


def document_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end: int = END,
    whole_words: bool = True,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` for every piece of every document."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    key = (hashlib.sha256(definition.encode()).hexdigest(), whole_words)
    sent = docs.sparkSession.sparkContext.broadcast(definition)  # bounded by the vocabulary
    last = array("I", [end]).tobytes()
    step = length * WIDTH

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _encoders:
            _encoders[key] = Encoder(sent.value, whole_words)
        encoder = _encoders[key]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.id, batch.body, strict=True):
                ids = encoder.ids(text) + last
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // WIDTH, len(part) // WIDTH, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            out["id"] = out["id"].astype(batch.id.dtype)
            yield out

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body")).mapInPandas(
        cut, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(
    lengths: np.ndarray,
    capacity: int = LENGTH,
    max_docs: int = LENGTH,
    max_cost: int = LENGTH * LENGTH,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    limits = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    w = np.array(weights, dtype=np.float64)
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    left = np.empty((len(lengths), 3), dtype=np.float64)  # residual capacities of the open sequences
    name = np.empty(len(lengths), dtype=np.int64)
    placed = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    n_open = n_all = 0
    for at in order:
        need = np.array([lengths[at], 1.0, float(lengths[at]) ** 2])
        open_ = left[:n_open]
        chosen = -1
        if n_open and open_[:, 0].max() >= need[0]:
            fits = np.flatnonzero((open_ >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = -((((open_[fits] - need) / limits) ** 2) @ w)
                else:
                    score = (open_[fits] / limits) @ (w * need / limits)
                chosen = int(fits[score.argmax()])
        if chosen < 0:
            if (need > limits).any():
                raise ValueError(f"a piece of {int(need[0])} tokens exceeds a capacity of an empty sequence")
            chosen, n_open, n_all = n_open, n_open + 1, n_all + 1
            left[chosen], name[chosen] = limits, n_all - 1
        placed[at], offset[at] = name[chosen], capacity - left[chosen, 0]
        left[chosen] -= need
        if left[chosen, 0] < shortest or left[chosen, 1] < 1:  # full: the last open one takes its place
            n_open -= 1
            left[chosen], name[chosen] = left[n_open], name[n_open]
    return placed, offset


def pack(pieces: DataFrame, group: int = GROUP, **capacities) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    groups = max(1, math.ceil(pieces.count() / group))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        placed, offset = best_fit(rows["length"].to_numpy(), **capacities)
        rows["sequence_id"] = placed + (TaskContext.get().partitionId() << 32)
        rows["offset"] = offset
        yield rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    # Dealt in turn: no key, so no hot key; rows are sorted first, so a repeated task gets the same rows.
    return pieces.repartition(groups).mapInPandas(fill, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(document_pieces(docs, tokenizer_path, id_col, **options), "pieces")
    return pack(pieces).withColumnRenamed("id", id_col)
