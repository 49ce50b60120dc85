import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.kernels import shingles, word_hashes
from vellum.llm.tokens import Encoder, default_path

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t  .'1", max_size=30)), min_size=1, max_size=6)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_have_one_hash_each(some):
    hashes, bounds = word_hashes(pa.array(some, pa.string()))
    known = {}
    for text, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
        assert len(words(text)) == b - a
        for word, h in zip(words(text), hashes[a:b].tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles_are_sets_of_windows(some, width):
    def windows(text):
        w = words(text)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    found = shingles(pa.array(some, pa.string()), width)
    for i, a in enumerate(some):
        assert len(found[i]) == len(windows(a))
        for j, b in enumerate(some):
            assert len(np.intersect1d(found[i], found[j])) == len(windows(a) & windows(b))


def test_a_slice_of_a_column_is_read_as_itself():
    column = pa.array(["a b", "c d e", None, "f"], pa.string()).slice(1, 2)
    assert [len(x) for x in shingles(column, 2)] == [2, 0]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_equal_those_of_whole_texts(some):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    whole.encode_special_tokens = True
    ours = test_ids_equal_those_of_whole_texts.__dict__.setdefault("ours", Encoder())
    want = [e.ids for e in whole.encode_batch_fast([x or "" for x in some], add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(pa.array(some, pa.string()))] == want


def test_forgetting_keeps_the_ids(texts):
    once, again = Encoder(), Encoder(most=1)
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(once.encode(texts), again.encode(texts), strict=True))


def test_strings_of_added_tokens_are_those_tokens():
    """Ids equal the library's by ``add_special_tokens=False`` alone, also where a text holds an added token's string."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = [x for t in added for x in (f"a {t} b", t, f"{t}{t} c", f" {t}", f"one{t}two", f"x  {t}\n{t} y", t[:-1], f"<{t}>")] + ["a b", ""]
    got = Encoder().encode(pa.array(texts))
    assert added and [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
