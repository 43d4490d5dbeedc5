import random
import zlib

import numpy as np
import pytest

from pathloom.llm import langid

WORDS = {"en": "the of and ing tion wh sh ou th er".split(), "de": "der die und ung sch ß ü keit ein ver".split(), "es": "que ción ñ de la os rr mente ado y".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def brute_phrases(seq, sample):
    """Greedy longest matches by substring search."""
    n, i = 0, 0
    while i < len(seq):
        k = 0
        while i + k < len(seq) and seq[i : i + k + 1] in sample:
            k += 1
        i += max(k, 1)
        n += 1
    return n


def parsed(m, texts):
    counts, sizes = m.phrases(texts)
    return counts.tolist(), sizes.tolist()


@pytest.mark.parametrize("block, portion", [(1, 7), (3, 40), (16, 2_000_000), (512, 2_000_000)])
@pytest.mark.parametrize("seed", range(4))
def test_parse_equals_brute_force(seed, block, portion, monkeypatch):
    """Whatever the blocks, and for texts longer than a portion too: the greedy parse of the whole text."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "PARSE_CHARS", portion)
    rng = random.Random(seed)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [made(40, "ab"), made(9, "abc")], "b": [made(60, "abc ")], "c": [made(rng.randint(1, 5), "c")]}
    m = langid.Model.of(samples, 8000)
    joined = {k: "".join("abc "[c - 2] if c else " " for c in np.concatenate([langid.classes(t, m.table) for t in v])) for k, v in samples.items()}
    texts = [made(n, "abcd") for n in (1, 2, 5, 30, 200, 31)] + [samples["a"][0] * 9, samples["b"][0] * 3, "c" * 90, "ddd", "a"]
    texts += [t.replace("d", " ") for t in texts]
    texts = [t for t in texts if t.strip()]
    norm = ["".join(" " if c == 0 else "abcd"[c - 2] if c > 1 else "d" for c in langid.classes(t, m.table)) for t in texts]
    counts, sizes = parsed(m, texts)
    assert sizes == [len(t) for t in norm]
    assert counts == [[brute_phrases(t, joined[k]) for k in m.langs] for t in norm]


def model():
    rng = random.Random(0)
    return langid.Model.of({k: [text(rng, k) for _ in range(30)] for k in WORDS}, 8000)


def test_texts_are_counted_alike_in_any_batch():
    rng, m = random.Random(2), model()
    texts = [text(rng, "de", n) for n in (1, 3, 50, 400)] + ["ü"]
    together = m.phrases(texts)
    one = [m.phrases([t]) for t in texts]
    assert np.array_equal(np.concatenate([c for c, _ in one]), together[0]) and np.array_equal(np.concatenate([s for _, s in one]), together[1])


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, k), k) for i, k in enumerate(rng.choice(list(WORDS)) for _ in range(300))]
    df = spark.createDataFrame([(i, t, k, "s") for i, t, k in rows], "doc_id long, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df, train_docs=40, train_chars=8000)).collect()}
    assert len(got) == 300 and 30 < sum(r.held_out for r in got.values()) < 90
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())


def test_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, "en"), "en") for i in range(20)] + [(100, None, "en"), (101, "", None), (102, "12 .,! 🙂", "en"), (103, "the", None), (103, "the", None), (None, "of the", "en"), (104, "日本語", None), (105, "the " * 60_000, None), (106, "THE OF AND", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102)) and all(by[i].lang_pred == "en" for i in (103, None, 104, 105, 106))
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"} and langid.identify(df.limit(0), none).count() == 0


def test_long_documents_and_rare_labels_are_learned(spark):
    rows = [(i, "licence " * 25 + f"word{i} " * 4000, "en") for i in range(5)] + [(10 + k, "brief", f"l{k}") for k in range(300) if (10 + k) % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = langid.samples(df, 200, 40_000).collect()
    held = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.lang for r in seen} >= {lang for _, _, lang in rows} - held
    text = "".join(r.text for r in sorted(seen, key=lambda r: r.before) if r.lang == "en")
    assert 40_000 <= len(text) < 40_200 and text.count("licence") < 0.1 * text.count("word")


def test_groups_of_languages_give_what_one_group_gives(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, text(rng, k), k) for i, k in enumerate(rng.choice(list(WORDS)) for _ in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, train_docs=40, train_chars=4000)
    one = sorted(langid.identify(df, model).collect())
    monkeypatch.setattr(langid, "GROUP_LANGS", 1)
    assert sorted(langid.identify(df, model).collect()) == one and len({r.lang_pred for r in one}) == 3


def test_no_two_letters_are_merged():
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(900)] + [chr(0x20000 + i) for i in range(100)]
    # words of equal lengths: only the letters tell the languages apart
    made = lambda k: " ".join("".join(rng.choice(letters[k::2]) for _ in range(3)) for _ in range(400))
    m = langid.Model.of({"a": [made(0)], "b": [made(1)]}, 8000)
    assert len({int(m.table[ord(c)]) for c in letters if m.table[ord(c)] > 1}) == sum(m.table[ord(c)] > 1 for c in letters) > 800
    assert [m.langs[k] for k in m.bits_per_character([made(0), made(1), made(0)]).argmin(axis=1)] == ["a", "b", "a"]


def test_clashing_names_are_kept(spark):
    rows = [(i, "the of and wh", "en", -7.5, "p", True, 3, "q") for i in range(6)] + [(9, None, "en", -7.5, "p", False, 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, held_out boolean, c0 int, bits string")
    out, new = langid.label(df, langid.fit(df))
    assert out.columns == [*df.columns, new] and new not in df.columns
    assert sorted(out.select(*df.columns).collect()) == sorted(df.collect()) and out.where(f"{new} = 'und'").count() == 1
    assert langid.identify(df, langid.fit(df)).columns == ["doc_id", "held_out", "lang_pred", "score"]
