"""Calls of the tokenizer while texts are encoded for packing."""

from pathlib import Path

import public_tokenizers

from modelsieve.llm import packing


def test_odd_words_of_a_text_go_through_the_tokenizer_in_one_call(monkeypatch):
    encoder = packing.Encoder(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"), True)
    text = "a1 b2-c3 plain word, x中 (odd) ... 7. Été! a1 b2-c3 ,"
    calls, merged = [], encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda texts: calls.append(sorted(texts)) or merged(texts))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text) == packing.array("I", whole).tobytes()
    assert sorted(calls, key=len)[-1] == sorted(["a1", "b2-c3", "x中", "(odd)", "...", "7.", ","])
    assert len(calls) == 3  # the others are the marks of "word," and "Été!"
    calls.clear()
    assert encoder.ids(text) == packing.array("I", whole).tobytes() and calls == []
