import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from encore.llm import scan
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n.é日\x1c\xa09-", max_size=30)), max_size=8)


def words_of(texts, alphabet, **how):
    out = []
    for first, data, offsets in scan.blocks(pa.array(texts, pa.string()), **how):
        found = scan.words(data, offsets, alphabet)
        for i in range(len(offsets) - 1):
            low, high = found.ptr[i], found.ptr[i + 1]
            cut = [data[a:b].tobytes().decode() for a, b in zip(found.start[low:high], found.end[low:high], strict=True)]
            out.append((cut, found.key[low:high].tolist()))
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for alphabet, words in ((scan.PLAIN, brute.blank_words), (scan.ALNUM, lambda t: brute.alnum_words(t))):
        found = words_of(texts, alphabet, size=16)
        assert len(found) == len(texts)
        for (cut, _), text in zip(found, texts, strict=True):
            folded = [w.translate(brute._LOWER) for w in cut] if alphabet is scan.ALNUM else cut
            assert folded == words(text)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_keys_agree_exactly_when_folded_words_do(texts):
    seen = {}
    for cut, keys in words_of(texts, scan.FOLDED):
        for word, key in zip(cut, keys, strict=True):
            assert seen.setdefault(word.translate(brute._LOWER), key) == key
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_is_scanned_in_slices_that_no_word_notices(monkeypatch):
    text = " ".join(f"w{i}" for i in range(400)) + " " + "x" * 300
    whole = words_of([text, "tail"], scan.PLAIN)
    monkeypatch.setattr(scan, "BLOCK", 64)
    assert words_of([text, "tail"], scan.PLAIN) == whole


def test_windows_are_equal_for_equal_runs_only():
    _, data, offsets = next(scan.blocks(pa.array(["a b c a b c d"])))
    runs = scan.windows(scan.words(data, offsets, scan.PLAIN).key, 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 4
    assert len(scan.windows(runs[:2], 3)) == 0


@pytest.mark.parametrize("texts", [[], [None], [""], [None, "", None]])
def test_nothing_to_scan(texts):
    assert [cut for cut, _ in words_of(texts, scan.PLAIN)] == [[] for _ in texts]
