"""Operator 9: a worker's encodings stay within their bound and its memory goes back."""

from riskfold.llm import bpe


def test_frequent_words_stay_and_the_result_does_not_depend_on_the_cache(monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    text = " ".join(["the the the", *(f"qz{chr(97 + k % 26)}{chr(97 + k // 26)}xv" for k in range(300)), "the"])
    whole = v.encode(text)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    small = bpe.Vocabulary(bpe.default_path())
    assert small.encode(text) == whole == small.encode(text)
    assert len(small.cache) == 8 and "the" in small.cache


def test_building_the_tables_releases_memory(monkeypatch):
    assert bpe.CACHE_WORDS <= 1 << 16 and bpe.PAIRS <= 1 << 17
    calls = []
    monkeypatch.setattr(bpe, "release", lambda: calls.append(1))
    bpe.vocabulary.cache_clear()
    bpe.vocabulary(bpe.default_path())
    assert calls == [1]
