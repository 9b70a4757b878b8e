import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from array import array  # noqa: E402

from tokenizers import Tokenizer  # noqa: E402

from gleanery.llm.bpe import Codec, encoded  # noqa: E402

PATH = P.path("word_bpe_49k.json")
MODEL = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
TREE = Codec(MODEL, leaf=128, unsplit=32)  # small, so that trees, windows and unsplit stretches occur
ALPHABET = "abcdeéèßİǅΣςτ'stremvlld0123 \n\t  !?.,;#*|<>ﬁ́中文日本😀👍🏽"


def ids(codec, text):
    return array("I", b"".join(next(codec.encode([text.encode()])))).tolist()


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=1500))
def test_random_text(text):
    assert ids(TREE, text) == expected(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "'re", "tion", "!!", "'", "er", "on", "中", "é", "9", "<|endoftext|>", "ha"]), min_size=100, max_size=600))
def test_unsplit_stretch(parts):
    text = "".join(parts)
    assert ids(TREE, text) == expected(text)


def test_unsplit_stretches_longer_than_the_production_leaf():
    rng = random.Random(7)
    codec = Codec(MODEL)
    for letters in ("ab", "tionheranding", "!?.", "0123456789", "aé中'!"):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        assert ids(codec, text) == expected(text)
    assert ids(codec, "a" * 50_000) == expected("a" * 50_000)
    assert ids(codec, "word and " * 20_000) == expected("word and " * 20_000)


def test_special_tokens_and_decoding():
    text = "A <|endoftext|> b<|startoftext|>c"
    got = ids(TREE, text)
    assert got == expected(text) and 49407 in got
    assert TREE.decode(next(TREE.encode([text.encode()]))).decode() == LIBRARY.decode(got, skip_special_tokens=False)


def test_table(spark):
    rows = [(1, "Some text", "x"), (1, "Some text", "x"), (None, None, None), (2, "", "y"), (3, "long " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out, names = encoded(df, PATH)
    got = out.collect()
    assert names["ids"] == "_ids" and len(got) == 5
    for r in got:
        text = next(t or "" for d, t, x in rows if (d, x) == (r["doc_id"], r["ids"]))
        assert r["_ids"] == expected(text) and r["n_tokens"] == len(r["_ids"])
        assert r["decoded"] == LIBRARY.decode(r["_ids"], skip_special_tokens=False)
    assert encoded(df.limit(0), PATH)[0].count() == 0


SPACED = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=1500))
def test_a_tokenizer_whose_tokens_hold_white_space(text):
    library, codec = Tokenizer.from_str(SPACED), Codec(SPACED, leaf=128, unsplit=32)
    assert not codec.worded and TREE.worded
    units = next(codec.encode([text.encode()]))
    want = library.encode(text, add_special_tokens=False).ids
    assert array("I", b"".join(units)).tolist() == want
    assert codec.decode(units).decode() == library.decode(want, skip_special_tokens=False)
