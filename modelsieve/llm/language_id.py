"""Language identification by a byte convolutional network.

A text is lower-cased, encoded as UTF-8 and cut into windows of WINDOW bytes, the last padded with
zeros. Bytes are embedded; filters of several widths slide over a window; the largest response of
each filter (at least 0) goes to a softmax over the languages. The probabilities of a text are the
mean over all its windows, weighted by their bytes. The whole text counts.

The network is trained in numpy on the driver, on a bounded sample of labelled rows: about
PER_LANGUAGE rows of each language, chosen by a hash of the id, and PIECES windows of each. The
number of languages is the size of the output layer. The weights (a few thousand numbers) travel
with the tasks, which predict batches of windows independently; nothing is shuffled.

Defined cases: a null text, or one without any letter, gets ``und`` with score 0; so does every
text if no row is labelled. Rows with a null id are never trained on and count as not held out.
Ties go to the language that sorts first. Repeated rows give repeated results. Only the id, text
and label columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 4
PER_LANGUAGE = 1200
PIECES = 2
EPOCHS = 6
#: Windows computed at a time.
BATCH = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (size, 256)
    filters: np.ndarray  # (FILTERS of each width, max width * size); narrow ones end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Response of each filter at each position: (filter, window, position)."""
        symbols = windows.reshape(-1)
        embedded = np.take(self.embedding, symbols, axis=1)
        size = len(embedded)
        runs = np.zeros((self.filters.shape[1], len(symbols)), dtype=np.float32)
        for j in range(max(WIDTHS)):
            runs[j * size : (j + 1) * size, : len(symbols) - j] = embedded[:, j:]
        found = (self.filters @ runs).reshape(len(self.filters), *windows.shape)
        return found[:, :, : windows.shape[1] - max(WIDTHS) + 1]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(windows).max(axis=2).T + self.bias, 0)
        logits = pooled @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str, window: int = WINDOW) -> bytes:
    """The lower-cased text in UTF-8, padded to whole windows."""
    raw = text.lower().encode("utf-8", "replace")
    return raw + bytes(-len(raw) % window)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7, window: int = WINDOW) -> Network:
    """Network for the labels, fitted to windows by Adam steps on the cross entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    number = {name: i for i, name in enumerate(languages)}
    parts, targets = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(windows_of(text, window), dtype=np.uint8).reshape(-1, window)
        parts.append(raw)
        targets.extend([number[label]] * len(raw))
    x, y = np.concatenate(parts), np.array(targets)
    total = FILTERS * len(WIDTHS)

    def normal(*shape: int, inputs: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(inputs)).astype(np.float32)

    widths = np.repeat(WIDTHS, FILTERS)
    # Which weights a filter has.
    mask = (np.arange(max(WIDTHS))[None, :] < widths[:, None]).repeat(EMBEDDING, axis=1).astype(np.float32)
    net = Network(
        languages,
        normal(EMBEDDING, 256, inputs=1),
        normal(total, max(WIDTHS) * EMBEDDING, inputs=EMBEDDING * 3) * mask,
        np.zeros(total, dtype=np.float32),
        normal(total, len(languages), inputs=total),
        np.zeros(len(languages), dtype=np.float32),
    )
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, x[chosen], y[chosen], mask), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    found = net.responses(x)
    places = found.argmax(axis=2)  # filter, window
    pooled = np.maximum(np.take_along_axis(found, places[:, :, None], axis=2)[:, :, 0].T + net.bias, 0)
    logits = pooled @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    error = np.exp(logits)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    # Only the position with the largest response passes the error on.
    back = (error @ net.out.T) * (pooled > 0)  # window, filter
    symbols = x[np.arange(len(x))[None, :, None], places[:, :, None] + np.arange(max(WIDTHS))]  # filter, window, offset
    runs = net.embedding.T[symbols].reshape(len(net.filters), len(x), -1)
    d_filters = np.einsum("fbk,bf->fk", runs, back) * mask
    d_runs = back.T[:, :, None] * net.filters[:, None, :]
    d_embedding = np.zeros_like(net.embedding.T)
    np.add.at(d_embedding, symbols.reshape(-1), d_runs.reshape(-1, len(net.embedding)))
    return [d_embedding.T, d_filters, back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]


def predict(net: Network | None, texts: list[str], window: int = WINDOW) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return named, scores
    asked = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    totals = np.zeros((len(texts), len(net.languages)))
    pending: list[bytes] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not held:
            return
        x = np.frombuffer(b"".join(pending), dtype=np.uint8).reshape(-1, window)
        owner = np.concatenate(owners)
        filled = np.count_nonzero(x, axis=1)[:, None]
        for at in range(0, len(x), BATCH):
            part = slice(at, at + BATCH)
            np.add.at(totals, owner[part], net.probabilities(x[part]) * filled[part])
        pending.clear()
        owners.clear()
        held = 0

    for i in asked:
        raw = windows_of(texts[i], window)
        pending.append(raw)
        owners.append(np.full(len(raw) // window, i))
        held += len(raw) // window
        if held >= 16 * BATCH:
            flush()
    flush()
    for i in asked:
        if totals[i].sum() > 0:
            share = totals[i] / totals[i].sum()
            best = int(share.argmax())
            named[i], scores[i] = net.languages[best], min(1.0, float(share[best]))
    return named, scores


def held_out(id_col: str) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    pieces: int = PIECES,
    window: int = WINDOW,
) -> list[tuple[str, str]]:
    """Pieces of labelled texts, ``(text, label)``, in an order that the rows alone decide."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("body")).where(
        ~held_out("id") & F.col("id").isNotNull() & F.col("label").isNotNull() & (F.length("body") > 0)
    )
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return []
    place = F.xxhash64(F.lit("training"), "id")
    million = 1_000_000
    share = F.create_map(
        *(F.lit(x) for name, n in counts.items() for x in (name, min(million, -(-per_language * million // n))))
    )
    chosen = labelled.where(F.pmod(place, F.lit(million)) < share[F.col("label")])
    # A piece holds about a window; where it starts follows from the id.
    cuts = [
        F.substring(
            F.col("body"),
            (F.pmod(F.xxhash64(F.lit(f"piece {k}"), "id"), F.greatest(F.length("body") - window, F.lit(1))) + 1).cast("int"),
            F.lit(window),
        )
        for k in range(pieces)
    ]
    rows = chosen.select(F.col("label"), place.alias("place"), "id", F.array(*cuts).alias("cuts")).collect()
    rows.sort(key=lambda r: (r["place"], str(r["id"]), r["label"], r["cuts"]))
    return [(text, r["label"]) for r in rows for text in r["cuts"] if _LETTER.search(text)]


def fit(docs: DataFrame, **options) -> Network | None:
    sample = training_sample(docs, **options)
    return train([t for t, _ in sample], [label for _, label in sample]) if sample else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named, scores = predict(net, batch.body.tolist())
            yield pd.DataFrame({"id": batch.id, "held_out": batch.held_out, "lang_pred": named, "score": scores})

    base = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("body"))
    found = base.mapInPandas(
        apply, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    )
    return found.withColumnRenamed("id", id_col)


def accepted(
    docs: DataFrame, net: Network | None, least_score: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents, with all their columns, whose language is known with at least ``least_score``."""

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        named, scores = predict(net, texts.tolist())
        return pd.Series([n != UNKNOWN and s >= least_score for n, s in zip(named, scores, strict=True)], dtype=bool)

    return docs.where(known(text_of(text_col)))
