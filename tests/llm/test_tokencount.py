import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm.tokencount import PrefixTable, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
T = PrefixTable(MODEL)
WORDS = st.lists(st.sampled_from(["the", "ingth", "  ", "\n", " ", "▁", "ß", "öheit", "12345", "\t", "日本", "🙂", "<s>", "<0x0A>", "!!", "a'b", "x" * 40, "   ", "%%%"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(WORDS, st.text(max_size=30)))
def test_count_equals_the_library(text):
    text = text.replace("\x00", "")
    assert T.count(text) == len(T.model.encode(text))


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_every_prefix_equals_re_encoding(text):
    assert T.prefix_counts(text).tolist() == [len(T.model.encode(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("limit", [0, 1, 3, 7, 50])
def test_fit_is_the_longest_prefix(limit):
    for text in ("", "hello there world\n  of  words", "\n\na b", "öheitß   x" * 5):
        want = max(i for i in range(len(text) + 1) if len(T.model.encode(text[:i])) <= limit)
        assert T.fit(text, limit) == want


def test_rows(spark):
    rows = [(1, "the cat", "x"), (2, None, "x"), (2, "", None), (None, "a " * 5000, "y")]
    got = {(r.doc_id, r.n_bytes): r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()}
    assert len(got) == 3 and got[2, 0].n_tokens == 0 and not got[2, 0].over_limit
    assert got[None, 10000].over_limit and got[None, 10000].n_tokens == len(T.model.encode("a " * 5000))


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_long_runs_of_spaces():
    for n in [*range(1, 70), 127, 128, 129, 1000, 1003]:
        for word in ("", "a", "hello there", "é", "日本", "🙂", "!x", "▁", "1"):
            text = " " * n + word
            assert T.count(text) == len(T.model.encode(text)), (n, word)
    text = "a" + " " * 70 + "hello🙂" + " " * 40
    assert T.prefix_counts(text).tolist() == [len(T.model.encode(text[:i])) for i in range(len(text) + 1)]
    began = time.time()
    assert T.count(" " * 100_000 + "x") == 6250 + 1 and T.fit(" " * 100_000, 100) > 1500 and time.time() - began < 5
