"""Token counts of all scripts against the library."""

import json
import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modelsieve.llm import token_count

DEFINITION = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
TOKENIZER = Tokenizer.from_str(DEFINITION)
SCRIPTS = ["abc xyz 12 's 't  \n\t", "éüñß", "привет мир", "漢字かな", "ܫܠܡܐ العربية", "हिन्दी", "€½²Ⅷ٣७", "😀👩‍👩‍👧‍️", "  　 \x85", "힣\U00020000́"]


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(DEFINITION, token_count.single_tokens(TOKENIZER))


def test_texts_of_all_scripts_count_as_the_library_counts(counter):
    rnd = random.Random(8)
    for _ in range(4000):
        parts = ["".join(rnd.choices(rnd.choice(SCRIPTS), k=rnd.randint(0, 6))) for _ in range(rnd.randint(0, 8))]
        if rnd.random() < 0.3:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(["<|endoftext|>", "<|endoftext", "|>", " <|endoftext|> "]))
        text = rnd.choice(["", " ", "  "]).join(parts)
        assert counter.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids), text


def test_only_pre_tokens_that_are_not_proven_are_merged(counter, monkeypatch):
    merged = []
    real = counter.tokenizer

    class Watched:
        pre_tokenizer = real.pre_tokenizer

        def encode_batch(self, texts, **options):
            merged.extend(texts)
            return real.encode_batch(texts, **options)

    monkeypatch.setattr(counter, "tokenizer", Watched())
    counter.count("The price of the house is 20 € of курс <|endoftext|> the house")
    assert merged and not set(merged) & set(counter.singles) and not any("house" in m or "<|" in m for m in merged)


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.update(normalizer={"type": "NFC"}),
        lambda d: d["pre_tokenizer"].update(add_prefix_space=True),
        lambda d: d.update(pre_tokenizer={"type": "Whitespace"}),
        lambda d: d.update(pre_tokenizer=None),
        lambda d: d["model"].update(end_of_word_suffix="</w>"),
        lambda d: d["added_tokens"][0].update(lstrip=True),
    ],
)
def test_other_definitions_are_refused(change):
    definition = json.loads(DEFINITION)
    change(definition)
    with pytest.raises(ValueError):
        token_count.check_definition(json.dumps(definition))
    token_count.check_definition(DEFINITION)
