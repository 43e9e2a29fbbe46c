"""Token counts by a whole-token shortcut.

Before the job, every string of the vocabulary is encoded alone. Those that are a single pre-token
and come back as a single token are proven to cost one token wherever they occur as a pre-token,
because merges never cross pre-tokens. A text is cut into pre-tokens; proven ones are counted, and
only the others are merged by the tokenizer, each distinct one once per worker's memory.

Texts are first cut at the tokenizer's special strings, which are one token each, as the tokenizer does
by default. Pre-tokens are then cut by a pattern whose letter and digit classes are written out for the
characters of ``KNOWN``, where Unicode versions agree, or where a part holds any other character by the
tokenizer's own pre-tokenizer. Both ways give the same pre-tokens, and every text is counted by them.

The pattern and the shortcut hold for byte-level BPE; a definition of another kind is refused.

Defined cases: a null text counts as empty and has no tokens. Each row gives one row, repeated rows
too. Only the id and text columns are read. Memory: the vocabulary and CACHE strings per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelsieve.llm.common import text_of

LIMIT = 1024
CACHE = 400_000
#: Characters that the pattern below classifies itself: Latin, and general punctuation.
KNOWN = (range(0x0000, 0x0250), range(0x2000, 0x2070))

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _class(kinds: tuple[str, ...]) -> str:
    return "".join(re.escape(chr(c)) for part in KNOWN for c in part if unicodedata.category(chr(c)) in kinds)


_LETTERS = _class(("Lu", "Ll", "Lt", "Lm", "Lo"))
_DIGITS = _class(("Nd", "Nl", "No"))
_SPACES = "\t-\r" + re.escape("\x85") + _class(("Zs", "Zl", "Zp"))
#: The pre-tokens of byte-level BPE: endings, words, numbers, other marks, white space.
PRE_TOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_UNKNOWN = re.compile("[^" + "".join(f"{re.escape(chr(p.start))}-{re.escape(chr(p.stop - 1))}" for p in KNOWN) + "]")


def byte_alphabet() -> dict[str, int]:
    """Byte for each printable stand-in that byte-level vocabularies are written in."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def single_tokens(tokenizer: Tokenizer) -> list[str]:
    """Vocabulary strings that are one pre-token and, encoded alone, one token."""
    alphabet = byte_alphabet()
    strings = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(alphabet[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not the stand-ins of a whole text
        if pre_tokens(tokenizer, text) == [text]:
            strings.append(text)
    strings.sort()
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


def check_definition(definition: str) -> None:
    """Refuse a tokenizer whose pre-tokens are not those of byte-level BPE, or that rewrites texts."""
    parts = json.loads(definition)
    cutter, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    byte_level = (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) == ("ByteLevel", False, True)
    plain_model = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
    )
    flags = ("lstrip", "rstrip", "single_word", "normalized")
    plain_specials = not any(t.get(f) for t in parts.get("added_tokens") or [] for f in flags)
    if parts.get("normalizer") or not (byte_level and plain_model and plain_specials):
        raise ValueError("token counts need a byte-level BPE definition without a normalizer")


def pre_tokens(tokenizer: Tokenizer, text: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if not _UNKNOWN.search(text):
        return PRE_TOKEN.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Counter:
    """Counts tokens of texts; remembers the cost of pre-tokens."""

    def __init__(self, definition: str, singles: list[str]) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        special = sorted((t["content"] for t in json.loads(definition).get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.singles = dict.fromkeys(singles, 1)
        self.cost = dict(self.singles)

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._count, parts))

    def _count(self, text: str) -> int:
        pieces = pre_tokens(self.tokenizer, text)
        new = list(set(pieces).difference(self.cost))
        if new:
            merged = self.tokenizer.encode_batch(new, add_special_tokens=False)
            self.cost.update(zip(new, (len(e.ids) for e in merged), strict=True))
        total = sum(map(self.cost.__getitem__, pieces))
        if len(self.cost) > CACHE + len(self.singles):
            self.cost = dict(self.singles)
        return total


_counters: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    check_definition(definition)
    key = hashlib.sha256(definition.encode()).hexdigest()
    # Bounded by the vocabulary.
    sent = docs.sparkSession.sparkContext.broadcast((definition, single_tokens(Tokenizer.from_str(definition))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _counters:
            _counters[key] = Counter(*sent.value)
        counter = _counters[key]
        for batch in batches:
            tokens = [counter.count(t) for t in batch.body]
            yield pd.DataFrame({"id": batch.id, "n_bytes": batch.n_bytes, "n_tokens": pd.Series(tokens, dtype="int64")})

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    counted = base.withColumn("n_bytes", F.octet_length("body").cast("bigint")).mapInPandas(
        count, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
