import random
import zlib

from pathloom.llm import toxicity


def corpus(spark, n=600):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "an", "ou", "sh"]) for _ in range(rng.randint(1, 4)))
    bad = ["scumbag", "worthless", "idiotic"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        t = [word() for _ in range(rng.choice([5, 40, 300]))]
        if toxic:
            for _ in range(max(2, len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(bad) + rng.choice(["", "!", ","])
        rows.append((i, " ".join(t)))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, lang string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_a_passage_in_a_long_text_counts(spark):
    docs, labels = corpus(spark)
    m = toxicity.fit(docs, labels)
    clean = "ther anou " * 5000
    assert m.score(clean) < 0.7 < m.score(clean + "scumbag worthless idiotic scumbag! worthless, " + clean)


def test_equal_texts_have_equal_scores_and_memo_changes_nothing(spark):
    docs, labels = corpus(spark, 200)
    m = toxicity.fit(docs, labels)
    t = "scumbag therou Anou sh"
    a = m.score(t)
    m.memo.clear()
    assert m.score("sh Anou therou scumbag") == a == m.score(t)


def test_edge_cases(spark):
    docs, labels = corpus(spark, 100)
    m = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "scumbag"), (3, "x" * 200_000), (3, "a"), (3, "a")], "doc_id long, text string")
    got = toxicity.score(odd, m).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(odd.limit(0), m).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).score("scumbag") < 0.01
    assert toxicity.fit(docs, labels.where("toxic = 1")).score("any") > 0.99
