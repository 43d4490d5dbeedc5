import random
import re
from collections import Counter

from pathloom.llm.quality import base_counts, judge


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}),
    )


def texts():
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "ö", "🙂x", "the", "##", "|", " ", " n", "x\x85y", "$5"])
    out = ["".join(word() + rng.choice([" ", "\n", "  ", "\t", "\r\n", "\x0b", "\n\n"]) for _ in range(rng.choice([0, 1, 2, 3, 10, 40, 200]))) for _ in range(150)]
    out += [" " + " ".join(str(rng.randint(0, 10**6)) for _ in range(300)) for _ in range(5)]
    many = [str(i) for i in range(3000)]
    return [*out, None, "", " \n ", "one", "\n".join([" ".join(many)] * 2), "same line\n" * 500, "x" * 200_000]


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, _n string, n_words int")
    for r in base_counts(df).collect():
        assert tuple(r)[1:] == brute(rows[r.doc_id][1]), rows[r.doc_id][1]


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        n = int(60 + rng.expovariate(1 / 150))
        rows.append((i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 8) + str(rng.randint(0, 99)) for _ in range(n)) + ".", "en" if i % 4 else None, "s"))
    rows.append((1000, " ".join("%$#|" * 30 + str(i) for i in range(300)), "en", "s"))
    rows.append((1001, "too short", "en", "s"))
    rows.append((1002, "again and again " * 60, "en", "s"))
    rows.append((1003, " ".join(f"w{i}" for i in range(80)), "xx", None))
    rows.append((1004, None, "yy", None))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_outliers_are_rejected_and_ordinary_texts_kept(spark):
    rows, df = corpus(spark)
    got = {r.doc_id: r for r in judge(df).collect()}
    assert len(got) == len(rows)
    assert not got[1000].base_failed and not got[1000].kept
    assert all(got[i].base_failed and not got[i].kept for i in (1001, 1002, 1004))
    assert got[1003].kept
    assert all(got[i].kept for i in range(400))


def test_nothing_but_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.base_failed, r.kept) for r in judge(df).collect()] == [(True, False)] * 2
    assert judge(df.limit(0)).count() == 0


def test_small_sources_lose_their_outliers(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = [rng.choice("abcdefgh") * rng.randint(1, 8) + str(rng.randint(0, 99)) for _ in range(int(60 + rng.expovariate(1 / 150)))]
        # 20 sources of 10 rows in a common language, and 40 languages of one row each
        rows.append((i, " ".join(words), *(("en", f"s{i % 20}") if i < 200 else (f"l{i}", "s"))))
    junk = [(1000 + i, " ".join("%$#|" * 30 + str(k) for k in range(200)), *where) for i, where in enumerate([("en", "s1"), ("en", "s2"), ("en", None), ("l999", "t")])]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert len(got) == len(rows + junk)
    assert not any(got[r[0]].base_failed or got[r[0]].kept for r in junk)
    assert all(got[i].kept for i in range(240))
