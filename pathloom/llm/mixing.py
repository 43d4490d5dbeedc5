"""Mixing sources to target weights with soft membership, in DataFrame functions only.

Domains come from a labelled table. A multinomial classifier over hashed words, beginnings of words and word shapes, trained on a bounded
sample of it, gives every document its posteriors p_k. Rates r >= 0 are then fitted to all documents so that each domain's expected
tokens, the sum of r x tokens x p_k, match its target: least squares by projected gradient, from r = 1, in the metric of the
tokens (long and short documents are moved alike). An iteration is one aggregation to a few numbers for each pair of domains;
the steps of all iterations are the whole state, so nothing grows with the documents but their own rows.

The targets' total is chosen so that the anchor domain keeps just the tokens it has. ``copies`` rounds a rate to whole
documents: up with its fraction's probability, by a hash of the id, so that copies are expected to meet the targets as rates
do, whatever the rate. Targets that no rates meet (of a domain without tokens, say) give a warning with what was reached.

Defined cases: null and empty texts have no tokens, posteriors by the priors, and stay; rows of one id are judged as one
text and share its rate; documents of equal posteriors have equal rates; without labels every rate is 1; extra columns,
whatever their names, are kept by ``apply``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, in_share, materialize, temporary, text_or_empty

BUCKETS, SHAPES = 8192, 1024  # of words and of beginnings each
SIZE = 2 * BUCKETS + SHAPES
DOMAINS = ("good", "low", "toxic")
#: Up to so many documents whose number of copies isn't 1 (16 bytes each) are broadcast; beyond, they are joined by shuffle.
FEW = 100_000
NO_ID = -(1 << 63)


def label_domain() -> Column:
    """The domain of a row of labels."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)


def _words(docs: DataFrame, one: DataFrame | None = None) -> DataFrame:
    """(id, word), with an empty word that keeps an empty text; beside each, the columns of the one row of ``one``."""
    d = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(docs["text"]).alias("t"))
    if one is not None:
        d = d.crossJoin(F.broadcast(one))
    return d.select("id", *(one.columns if one is not None else ()), F.explode(F.split("t", r"[\x20\x09-\x0D]")).alias("w"))


def _features(w: Column) -> tuple[Column, ...]:
    """The whole word, its beginning (endings vary), and its first and last characters as they are written."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")
    shape = F.pmod(F.hash(F.ascii(w), F.ascii(F.right(w, F.lit(1)))), F.lit(SHAPES)).cast("int")
    return bucket(F.lower(w)), bucket(F.left(F.lower(w), F.lit(4))) + BUCKETS, shape + 2 * BUCKETS


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 12_000, smooth: float = 0.5) -> tuple[list[list[float]], list[float]] | None:
    """Weights of each domain for each feature, and the log priors. The sample: labelled ids with the least hashes."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic")).where("id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("id").agg(F.max(label_domain()).alias("domain"))
    shares = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    near = known.where(in_share("id", 1.2 * sample_docs / sum(shares.values())))
    chosen = near.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left_semi")
    one_each = texts.groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("id")).select("id").distinct()  # copies count once
    chosen = materialize(chosen.join(F.broadcast(one_each), "id", "left_semi"), "labelled-sample")
    words = _words(texts).where("w <> ''").join(F.broadcast(chosen), "id")
    both = words.select("id", "domain", F.explode(F.array(*_features(F.col("w")))).alias("f"))
    per = both.groupBy("id", "domain", "f").agg(F.count("*").alias("n"))
    size, domains = SIZE, len(DOMAINS)
    c, docs_with = [[0.0] * size for _ in range(domains)], [[0.0] * size for _ in range(domains)]
    for r in per.groupBy("domain", "f").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():  # size x domains rows at most
        c[r.domain][r.f] += r.n
        docs_with[r.domain][r.f] += r.m
    everything, everywhere = ([sum(x[k][f] for k in range(domains)) for f in range(size)] for x in (c, docs_with))
    total, sampled = sum(everything) or 1.0, chosen.groupBy("domain").count().collect()
    of = {r.domain: r["count"] for r in sampled}
    weights = []
    for k in range(domains):
        expected = [n * sum(c[k]) / total for n in everything]
        share = of.get(k, 0) / max(1, sum(of.values()))
        # a sign of the domain: the number of its documents with the feature is far from what chance gives, and so are its uses
        log_ratio = [math.log((c[k][f] + smooth) / (expected[f] + smooth)) for f in range(size)]
        differs = [abs(log_ratio[f]) > 0.7 and abs(docs_with[k][f] - everywhere[f] * share) > 5 * math.sqrt(everywhere[f] * share * (1 - share) + 1) for f in range(size)]
        rest, rest_expected = (sum(x[f] for f in range(size) if not differs[f]) for x in (c[k], expected))
        common = math.log((rest + smooth) / (rest_expected + smooth))  # what other features tell
        weights.append([log_ratio[f] if differs[f] else common for f in range(size)])
    labelled = sum(shares.values())
    return weights, [math.log((shares.get(k, 0) + smooth) / (labelled + smooth * domains)) for k in range(domains)]


def posteriors(docs: DataFrame, model: tuple[list[list[float]], list[float]], heat: float = 0.4) -> DataFrame:
    """Per id: id, n_tokens, p0.. (``heat`` softens the evidence, as neighbouring features are no independent witnesses).

    The weights are one row of ``SIZE`` x domains numbers (half a megabyte), broadcast: as literals in the plan they would be in
    each of its descriptions, and as a table of rows each word would be joined three times.
    """
    weights, priors = model
    spark, ks = docs.sparkSession, range(len(weights))
    flat = [float(w[f]) for f in range(SIZE) for w in weights]
    one = materialize(spark.createDataFrame([(flat,)], "weights array<double>").coalesce(1), "domain-weights")
    w = F.col("w")
    words = _words(docs, one).select("id", "weights", (w != "").cast("int").alias("n"), *(f.alias(f"f{i}") for i, f in enumerate(_features(w))))
    of = lambda k: sum((F.get("weights", F.col(f"f{i}") * len(weights) + k) for i in (1, 2)), F.get("weights", F.col("f0") * len(weights) + k))
    some = words.groupBy("id").agg(F.sum("n").cast("long").alias("n_tokens"), *(F.sum(F.when(F.col("n") == 1, of(k)).otherwise(0.0)).alias(f"z{k}") for k in ks))
    z = [F.col(f"z{k}") * heat + priors[k] for k in ks]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    return some.select("id", "n_tokens", *((x / sum(e[1:], e[0])).alias(f"p{k}") for k, x in enumerate(e)))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b by elimination with pivots; a is small and made regular by its caller."""
    m = [[*row, v] for row, v in zip(a, b, strict=True)]
    n = len(m)
    for i in range(n):
        j = max(range(i, n), key=lambda k: abs(m[k][i]))
        m[i], m[j] = m[j], m[i]
        for k in range(i + 1, n):
            f = m[k][i] / m[i][i]
            m[k] = [x - f * y for x, y in zip(m[k], m[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (m[i][n] - sum(m[i][k] * x[k] for k in range(i + 1, n))) / m[i][i]
    return x


def rates(p: DataFrame, targets: dict[str, float], anchor: str = "good", most: int = 30, close: float = 1e-4) -> DataFrame:
    """(id, n_tokens, p0..) -> the same and rate.

    The gradient is scaled by the Gram matrix of the posteriors over the rows that are not at zero, so a handful of
    iterations is enough. The steps so far stand in one array literal: the plan's code is the same in every iteration.
    """
    n = len(DOMAINS)
    ks = range(n)
    there = list(p.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in ks)).first())
    scale = sum(targets.values())
    share = [targets[d] / scale for d in DOMAINS]
    total = there[DOMAINS.index(anchor)] / share[DOMAINS.index(anchor)]
    wanted = [s * total for s in share]
    steps: list[list[float]] = []

    def rate() -> Column:
        if not steps:
            return F.lit(1.0)
        table = F.transform(F.split(F.lit(";".join(",".join(map(repr, s)) for s in steps)), ";"), lambda s: F.split(s, ",").cast("array<double>"))
        return F.aggregate(table, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((F.col(f"p{k}") * F.get(s, F.lit(k)) for k in ks), F.lit(0.0))))

    for _ in range(most):
        d = p.select("n_tokens", *(f"p{k}" for k in ks), rate().alias("r"))
        t = F.col("n_tokens")
        gram = [F.coalesce(F.sum(F.when(F.col("r") > 0, t * F.col(f"p{i}") * F.col(f"p{j}"))), F.lit(0.0)) for i in ks for j in ks]
        got = list(d.agg(*(F.coalesce(F.sum(F.col("r") * t * F.col(f"p{k}")), F.lit(0.0)) for k in ks), *gram).first())
        have, g = got[:n], [got[n + n * i : n + n * (i + 1)] for i in ks]
        if all(abs(h - w) <= close * max(w, 1.0) for h, w in zip(have, wanted, strict=True)):
            break
        ridge = 1e-9 * (1.0 + sum(g[i][i] for i in ks))
        steps.append(_solve([[g[i][j] + ridge * (i == j) for j in ks] for i in ks], [h - w for h, w in zip(have, wanted, strict=True)]))
    else:
        warnings.warn(f"no rates found that meet the targets: tokens {have} for {wanted}", RuntimeWarning, stacklevel=2)
    return p.withColumn("rate", rate())


def copies() -> Column:
    u = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + u).cast("long")


#: Shares of the tokens; the anchor's share is the largest of what it has, so its documents stay.
TARGETS = {"good": 0.95, "low": 0.03, "toxic": 0.02}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **how) -> DataFrame:
    """Per id: doc_id, n_tokens, p_good, p_low, p_toxic, rate, copies."""
    with temporary(docs.sparkSession):
        model = fit(docs, labels, **how)
    if model is None:
        p = _words(docs).groupBy("id").agg(F.sum((F.col("w") != "").cast("int")).cast("long").alias("n_tokens")).select("*", *(F.lit(1.0 if k == 0 else 0.0).alias(f"p{k}") for k in range(len(DOMAINS)))).withColumn("rate", F.lit(1.0))
    else:
        with temporary(docs.sparkSession):
            p = rates(materialize(posteriors(docs, model), "posteriors", keep=True), targets or TARGETS)
    rate = F.col("rate")
    out = p.withColumn("rate", F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", copies().alias("copies"))


def apply(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Docs, each as often as its rate says, with the same columns."""
    key, n = fresh(docs, "key"), fresh(docs, "n")
    odd = materialize(mixed.where("copies <> 1").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("copies").alias(n)), "copies")
    if odd.limit(FEW + 1).count() <= FEW:
        odd = F.broadcast(odd)
    columns = docs.columns
    rows = docs.withColumn(key, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))).join(odd, key, "left")
    rows = rows.withColumn(n, F.coalesce(n, F.lit(1).cast("long"))).where(F.col(n) > 0)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))).select(*(F.col(f"`{c}`") for c in columns))
