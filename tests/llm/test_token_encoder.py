"""The encoder of the token files, which cuts texts into parts, against the library on whole texts."""

import random

import pytest
from shotweave.llm import token_files
from shotweave.llm.bpe import default_vocabulary

LETTERS = [*"aAbBeéÉßςΣİı \t\n\x0b\x1c\x85\xa0 ​̱́!?.,'’<|>$%01२½漢字ㄱ한\U0001F600ا", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", "aaaa", "!!!!!", "H̱", "ab!cd"]


@pytest.mark.parametrize("remembered", [1_000_000, 50])
def test_parts_against_whole_texts(monkeypatch, remembered):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))).encode() for _ in range(4000)]
    encoder, whole = token_files.TextEncoder(default_vocabulary()), token_files.TextEncoder(default_vocabulary())
    assert encoder.by_word
    whole.by_word = False
    for k in range(0, len(texts), 500):
        assert encoder.encode(texts[k:k + 500]) == whole.encode(texts[k:k + 500])
    assert encoder.encode([]) == [] and encoder.encode([None, b"", b" \n"]) == [b""] * 3
