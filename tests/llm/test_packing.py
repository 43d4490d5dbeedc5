import random
import zlib

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm.packing import Ids, best_fit, cross, evolve, pack, pieces

FILE = public_tokenizers.path("word_bpe_49k.json")
IDS, TOK = Ids(FILE), Tokenizer.from_file(FILE)
TEXT = st.lists(st.sampled_from(["The", "words", " ", "\n", "  ", "öheit", "ÀÉ", "it's", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "12", ".", ",", "!!", "a.b", "ﬁ", "ΣΑΣ", "é", "日本", "🙂", "İ", "\t", "\x1c", " ", "x" * 60, "word.", "ª", "µ", "ß", "_"]), max_size=14).map("".join)


def want(text):
    return b"".join(i.to_bytes(4, "little") for i in TOK.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=20), st.text(st.characters(max_codepoint=0x260), max_size=25)), max_size=4))
def test_ids_equal_the_library(texts):
    assert [bytes(x) for x in IDS.of(pa.array(texts, pa.string()))] == [want(t) for t in texts]
    assert [bytes(x) for x in IDS.of(pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts)))] == [want(t) for t in texts]


def bins_are_right(bins, size, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(0, 99))
def test_packings_hold_every_item_once(size, seed):
    rng, order = random.Random(seed), sorted(range(len(size)), key=lambda i: -size[i])
    a = best_fit(order, size, 50, [])
    b = best_fit(rng.sample(order, len(order)), size, 50, [])
    bins_are_right(a, size, 50)
    bins_are_right(cross(a, b, size, 50, rng), size, 50)
    best = evolve(size, 50, [b], rng, 4, 10)[0]
    bins_are_right(best, size, 50)
    assert len(best) <= min(len(a) + 1, len(b))


def check(rows, got, capacity):
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids, mine = want(text or "") + bytes(4), docs[doc_id]
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in mine} == {(k, s // 4, len(p) // 4, zlib.crc32(p)) for k, s in enumerate(range(0, len(ids), 4 * capacity)) for p in [ids[s : s + 4 * capacity]]}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "hat", "ing", "schreiben", "x1"]) for _ in range(rng.choice([1, 5, 20, 60, 200])))) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, uid string, length long")
    got = pack(pieces(df, FILE, 64), 64, block_items=60).collect()
    total = sum(r.length for r in got)
    assert check(rows, got, 64) <= total / 64 * 1.03 + 2


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.length)) for r in pack(pieces(df, FILE), 2048).collect()) == ["(1, 3)", "(1, 3)", "(None, 2)"]
    assert pack(pieces(df.limit(0), FILE)).count() == 0
