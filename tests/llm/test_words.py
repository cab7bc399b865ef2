import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.llm.words import chunks, shingles, word_hashes, words_of

CASES = ["", None, "  ", "<paragraph></paragraph>", "Año 2010: ¿ÁRBOL?", "año 2010 árbol", "Straße STRASSE", "ﬁn ½ x²", "a<b>c</b>d", "𝔸 b 😀", "x" * 3000, "1 < 2"]


def test_hashes_agree_with_plain_words():
    hashes, offsets = word_hashes(CASES)
    seen: dict = {}
    for text, a, b in zip(CASES, offsets[:-1], offsets[1:]):
        words = words_of(text)
        assert len(words) == b - a, (text, words)
        for w, h in zip(words, hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_accents_case_and_tags_do_not_count():
    for x, y in [("Año ÁRBOL", "anõ arbol".replace("anõ", "año")), ("Straße", "STRASSE"), ("<p>uno</p> dos", "Uno, dos.")]:
        assert word_hashes([x])[0].tolist() == word_hashes([y])[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_any_texts(texts):
    hashes, offsets = word_hashes(texts)
    alone = [word_hashes([t])[0].tolist() for t in texts]
    assert [hashes[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == alone


def test_shingles_depend_on_order():
    h = word_hashes(["a b c", "c b a"])[0]
    s = shingles(h, 3)
    assert s[0] != s[3] and len(shingles(h, 7)) == 0


@pytest.mark.parametrize("size", [1, 5, 100])
def test_chunks_cover(size):
    texts = ["ab", None, "", "abcdefghijk", "c"]
    got = [t for s in chunks(texts, size) for t in texts[s]]
    assert got == texts
    assert np.sum([1 for _ in chunks([], size)]) == 0
