"""The fast encoder against the vocabulary's own library."""

import random

import pytest

from siftspark.llm import tokens
from siftspark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def words():
    return tokens.WordEncoder(vocabulary())


def test_probe_allows_the_faster_way(words):
    assert words.plain is tokens._PLAIN


@pytest.mark.parametrize("stretch", [1, 40, 1 << 19])
def test_ids_equal_the_library(words, monkeypatch, stretch):
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", stretch)
    r = random.Random(5)
    letters = "ab'stmdrevl '\"-1 2Àß\n\té“x漢,.\x01\x02\x03\x07\x7f÷×\xa0Z"
    for _ in range(300):
        texts = ["".join(r.choices(letters, k=r.randrange(40))) for _ in range(6)]
        assert words.encode(texts) == words._whole(texts), texts
    assert words.encode(["", " ", "<|endoftext|> a"]) == words._whole(["", " ", "<|endoftext|> a"])


def test_other_rules_go_to_the_library(words, monkeypatch):
    monkeypatch.setattr(words, "plain", tokens._NEVER)
    texts = ["It's a text of 12 words", "Ünlike çthers"]
    assert words.encode(texts) == words._whole(texts)
