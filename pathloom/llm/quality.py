"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant, in DataFrame functions.

The base counts of a text need no shuffle. The statistic vector (log of the words, mean word length, and the rates of
symbols, repeated lines and repeated words, each transformed to be less skewed) is judged within the document's language and
source by a deterministic MCD. It has three starts: the share ``h`` of rows nearest to the coordinates' medians by the sum of
squares in units of their spreads, the same by the largest of them, and the share nearest by the classical estimate over all
rows. Each concentration step takes mean and covariance of the share ``h`` of rows with the least distances, all groups and
starts at once, and of a group's starts the one whose covariance has the least determinant stands. Distances are binned on a
fixed logarithmic grid, so a group's limit is a sum over at most ``BINS`` counts, exact and alike in every run, and no group
is ever gathered. The inverse covariance is a Cholesky factor in column expressions. Distances are made consistent by the
median of the squared ones. Rows beyond ``cut`` robust distance are rejected; each coordinate has a least spread. A group under ``least_rows`` rows is judged by the estimate over all rows of
its language, so every row gets a verdict. Where the language has fewer, its spreads are those over all rows, and its place
is the mean of its rows' medians, counted once for each row, and of the place of all rows, counted once: words are longer in
one language than in another.

Defined cases: null text has no words; null language or source is a group of its own; repeated rows count each; rows at equal
distances are taken or left together; of starts with equal determinants the first stands; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_or_empty

BINS, PER_E = 640, 32.0  # the grid: 32 bins for each factor e of the squared distance
#: Up to so many groups (a few hundred bytes each) are broadcast; beyond, they are joined by shuffle.
FEW_GROUPS = 2_000
BLANK = r"[\x20\x09-\x0D]+"
#: The transformed statistics and the least standard deviation of each: where a group hardly varies in one (no repeated line
#: in it, say), a single such line is no outlier.
SPREADS = {"x0": 0.2, "x1": 0.03, "x2": 0.04, "x3": 0.35, "x4": 0.08}
STATS = tuple(SPREADS)


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(docs[c].alias(c) for c in keep), text_or_empty(docs["text"]).alias("_t"))
    d = d.withColumn("_core", F.regexp_replace("_t", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))
    d = d.withColumn("_w", F.when(F.col("_core") == "", F.array().cast("array<string>")).otherwise(F.split("_core", BLANK)))
    d = d.withColumn("_n", F.size("_w")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    # windows of three words by hash; those that occur again, by sorting (hash, place) packed in one long
    d = d.withColumn("_g", F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    d = d.withColumn("_s", F.when(F.col("_again"), F.sort_array("_g")).otherwise(F.array().cast("array<bigint>")))
    # a window occurs again iff its hash is one of the sorted hashes that equal a neighbour
    d = d.withColumn("_twice", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1)))))
    few = F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: F.array_contains("_twice", F.get("_g", i)))
    # with many repeated hashes a search for each would be quadratic: sort the places of windows by hash instead
    order = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_o", F.when(F.size("_twice") > 64, order))
    many = F.transform(
        F.filter("_o", lambda x, k: F.coalesce(F.get("_o", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_o", k + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    )
    d = d.withColumn("_p", F.when(~F.col("_again"), F.array().cast("array<int>")).when(F.size("_twice") > 64, F.sort_array(many)).otherwise(few))
    covered = F.aggregate(F.transform("_p", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("_p", i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        "doc_id",
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_core", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _vector(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return d.withColumns(
        {
            "x0": F.log1p(F.col("n_words").cast("double")),
            "x1": F.log1p(F.col("word_chars") / n),
            "x2": F.sqrt(F.col("n_symbols") / n),
            "x3": F.log1p(F.col("n_dup_lines").cast("double")),
            "x4": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _with_groups(rows: DataFrame, groups: DataFrame, starts: int = 1) -> DataFrame:
    if groups.limit(starts * FEW_GROUPS + 1).count() <= starts * FEW_GROUPS:
        groups = F.broadcast(groups)
    return rows.join(groups, "g")


def _bin(value: Column) -> Column:
    """Of a squared distance; bin 0 is below e**-10."""
    return F.least(F.greatest(F.floor((F.ln(F.greatest(value, F.lit(1e-30))) + 10) * PER_E), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _limits(binned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(g, b) rows -> per group, for each share, the least bin at or below which that share of the rows lies."""
    counts = binned.groupBy("g", "b").agg(F.count("*").alias("n"))
    lists = counts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("l"), F.sum("n").alias("rows"))  # BINS entries at most

    def at(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("b"))
        return F.aggregate("l", start, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["n"] < F.ceil(F.col("rows") * share), x["b"]).otherwise(a["b"]).alias("b")))["b"]

    return lists.select("g", "rows", *(at(s).alias(k) for k, s in shares.items()))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each group's covariance (with the least spreads), as m0.. and l00.. columns, and the log
    of its determinant."""
    p = len(STATS)
    sums = rows.groupBy("g").agg(F.count("*").alias("c"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)), *(F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)))
    d = sums
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                v = F.greatest(v, F.lit(0.0)) + SPREADS[STATS[i]] ** 2
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-6))) if i == j else v / F.col(f"l{j}{j}"))
    log_det = 2 * sum((F.ln(f"l{i}{i}") for i in range(p)), F.lit(0.0))
    return d.select("g", log_det.alias("log_det"), *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution; drops the moments."""
    used = []
    for i, x in enumerate(STATS):
        y = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
        used += [f"m{i}", f"y{i}", *(f"l{i}{j}" for j in range(i + 1))]
    return rows.withColumn(name, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(STATS))), F.lit(0.0))).drop("log_det", *used)


def _pools(d: DataFrame, least_rows: int) -> DataFrame:
    """(g, gl, base_failed) rows -> per g: own, the group that judges its rows, and feeds, the groups whose estimates they enter."""
    sizes = materialize(d.groupBy("g", "gl").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")), "quality-sizes")
    langs = materialize(sizes.groupBy("gl").agg(F.sum("n").alias("nl"), F.max(F.col("n") < least_rows).alias("small")), "quality-langs")
    if langs.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        langs = F.broadcast(langs)
    pooled = langs.where(F.col("nl") < least_rows).limit(1).count() > 0
    few, lang_few = F.col("n") < least_rows, F.col("nl") < least_rows
    feeds = F.array_compact(F.array(F.when(~few, F.col("g")), F.when(F.col("small") & ~lang_few, F.col("gl")), F.lit("all" if pooled else None).cast("string")))
    own = F.when(~few, F.col("g")).when(~lang_few, F.col("gl")).otherwise(F.lit("all"))
    return materialize(sizes.join(langs, "gl").select("g", own.alias("own"), feeds.alias("feeds")), "quality-pools")


def judge(docs: DataFrame, h: float = 0.75, steps: int = 4, cut: float = 12.0, least_rows: int = 30) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, distance (robust)."""
    d = _vector(base_counts(docs, ("lang", "source")))
    part = lambda c: F.coalesce(F.hex(F.col(c).cast("string")), F.lit("~"))
    d = d.withColumns({"g": F.sha2(F.concat_ws("|", part("lang"), part("source")), 256), "gl": F.sha2(part("lang"), 256)}).drop("lang", "source")
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    d = materialize(d, "quality-counts")
    pools = _pools(d, least_rows)
    vectors = materialize(_with_groups(d.where("not base_failed"), pools.select("g", "feeds")).select(F.explode("feeds").alias("g"), *STATS), "quality-vectors")
    d = _with_groups(d, pools.select("g", "own")).withColumn("g", F.col("own")).drop("own")

    # starts; a start of a group is a group of its own, named group#start, until the best is chosen
    middle = vectors.groupBy("g").agg(*(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i, x in enumerate(STATS)))
    middle = materialize(middle, "quality-middle")
    z = lambda i, x: F.pow((F.col(x) - F.get(f"q{i}", F.lit(1))) / F.greatest(F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0)), F.lit(SPREADS[x])), 2)
    classical = materialize(_moments(vectors), "quality-classical").withColumnRenamed("g", "gc")
    near = _with_groups(vectors, middle).withColumn("gc", F.col("g"))
    near = near.join(F.broadcast(classical) if classical.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else classical, "gc")
    each = [z(i, x) for i, x in enumerate(STATS)]
    near = _distance(near.withColumns({"d0": sum(each, F.lit(0.0)), "d1": F.greatest(*each)}), "d2")
    rows = near.select("g", *STATS, F.posexplode(F.array("d0", "d1", "d2")).alias("start", "d")).select(F.concat_ws("#", "g", "start").alias("g"), *STATS, _bin(F.col("d")).alias("b"))
    started = vectors.withColumn("g", F.explode(F.array(*(F.concat("g", F.lit(f"#{k}")) for k in range(3)))))
    for _ in range(steps):  # concentration
        limits = materialize(_limits(rows.select("g", "b"), {"top": h}).select("g", "top"), "quality-limits")
        moments = materialize(_moments(_with_groups(rows, limits, 3).where(F.col("b") <= F.col("top"))), "quality-moments")
        rows = _distance(_with_groups(started, moments, 3), "d").select("g", *STATS, _bin(F.col("d")).alias("b"))
    best = moments.select(F.split("g", "#")[0].alias("group"), "g", "log_det").groupBy("group").agg(F.min(F.struct("log_det", "g"))["g"].alias("g"))
    moments = materialize(moments.join(best, "g").drop("g").withColumnRenamed("group", "g"), "quality-best")
    rows = _distance(_with_groups(vectors, moments), "d").select("g", *STATS, _bin(F.col("d")).alias("b"))
    # consistency: where the median squared distance of a group is above that of 5 normal coordinates, it is the unit
    scale = materialize(_limits(rows.select("g", "b"), {"half": 0.5}).select("g", F.greatest(F.exp((F.col("half") + 0.5) / PER_E - 10) / 4.351, F.lit(1.0)).alias("unit")), "quality-scale")
    places = d.where("g = 'all' and not base_failed").groupBy("gl").agg(F.count("*").alias("nl"), *(F.percentile_approx(x, 0.5, 2000).alias(f"q{i}") for i, x in enumerate(STATS)))
    places = materialize(places, "quality-places")
    if places.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        places = F.broadcast(places)
    placed = _with_groups(d, moments.join(scale, "g")).join(places, "gl", "left")
    placed = placed.withColumns({x: F.col(x) - F.coalesce(F.col("nl") / (F.col("nl") + 1) * (F.col(f"q{i}") - F.col(f"m{i}")), F.lit(0.0)) for i, x in enumerate(STATS)})
    measured = _distance(placed, "d")
    measured = measured.withColumn("distance", F.sqrt(F.col("d") / F.col("unit"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (F.col("distance") <= cut).alias("fits"))
    lone = d.join(moments.select("g"), "g", "left_anti").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(True).alias("fits"))
    return measured.unionByName(lone).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("fits")).alias("kept"), "distance")
