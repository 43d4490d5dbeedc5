"""Document fingerprints as invertible Bloom lookup sketches over paragraphs, in DataFrame functions only.

A paragraph is a line that holds more than blanks; its digest is a 64-bit hash. A fingerprint has ``CELLS`` cells, three
ranges of four; every distinct digest adds itself to one cell of each range: a count, the exclusive or of the digests, the
exclusive or of check values. Two fingerprints subtract cell by cell, and peeling (cells of one digest give it away and are
cleared everywhere) recovers the digests in which the texts differ. Where that fails, larger sketches are built: level n has
4^n independent sketches, one for each value of some bits of the digest, and new hashes. Cells of a level are made by one
aggregation and never by a loop over a document's paragraphs, so very long documents are no quadratic task.

The likeness of two fingerprints is the Jaccard similarity of their digest sets, (a + b - d) / (a + b + d), where a and b
are the numbers of digests and d that of the recovered ones; two empty fingerprints have likeness 1.

The edited text needs the next document. Ids are cut into ranges, as even as quantiles make them; the first document of each
range is also sent to the range before it, so each range finds all its neighbours by itself, after one shuffle of the texts.

Defined cases: null text is empty; rows of one id are consecutive documents, in order of their texts; a single document is
its own next one; a null id comes after every other (it is the last document); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, parts, text_or_empty

RANGES, WIDTH = 3, 4
CELLS = RANGES * WIDTH
ROUNDS, MOST_LEVELS = 8, 12
#: Ranges of ids; what reaches the driver has a row for each.
MOST_RANGES = 20_000
LEAST_ID = -(1 << 63)


def _with_next(rows: DataFrame) -> DataFrame:
    """(id, text) -> (id, text, next): the text of the following row by descending id."""
    spark = rows.sparkSession
    n = min(4 * parts(spark), MOST_RANGES)
    found = rows.select("id").agg(F.percentile_approx("id", [k / n for k in range(1, n)], min(20 * n, 200_000)).alias("q"), F.max("id").alias("top")).first()
    bounds = sorted(set(found.q or []))
    text = F.lit(",".join(map(str, bounds)))
    edges = F.split(text, ",").cast("array<long>") if bounds else F.array().cast("array<long>")
    # binary search in the literal array: the number of bounds below the id
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))))
    r = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < F.col("id"), at + step).otherwise(at))
    placed = rows.withColumn("r", r)
    tops = {x.r: x.top for x in placed.groupBy("r").agg(F.max("id").alias("top")).collect()}  # one row for each range, n at most
    order = sorted(tops)
    before = {tops[k]: (order[i + 1] if i + 1 < len(order) else order[0], int(i + 1 == len(order))) for i, k in enumerate(order)}
    if before:
        pairs = ",".join(f"{i}:{to}:{wrap}" for i, (to, wrap) in before.items())
        ghosts = spark.range(1).select(F.explode(F.split(F.lit(pairs), ",")).alias("p")).select(
            F.split("p", ":")[0].cast("long").alias("gid"), F.split("p", ":")[1].cast("int").alias("to"), F.split("p", ":")[2].cast("int").alias("wrap")
        )
        extra = rows.join(F.broadcast(ghosts), F.col("id") == F.col("gid")).select("id", "text", F.col("to").alias("r"), "wrap", F.lit(True).alias("ghost"))
    else:
        extra = placed.select("id", "text", "r", F.lit(0).alias("wrap"), F.lit(True).alias("ghost")).limit(0)
    both = placed.select("id", "text", "r", F.lit(0).alias("wrap"), F.lit(False).alias("ghost")).unionByName(extra)
    order_in = Window.partitionBy("r").orderBy("wrap", F.desc("id"), "text", "ghost")
    return both.withColumn("next", F.lead("text").over(order_in)).where("not ghost").select("id", "text", "next")


def _digests(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(digest: Column, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(level)), 32)


def _cell(digest: Column, level: int, k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(level)), 5 * k).bitwiseAND(F.lit(WIDTH - 1).cast("long")).cast("int") + k * WIDTH


def cells(pairs: DataFrame, level: int) -> DataFrame:
    """(key, which, a, b), two digest arrays -> (key, which, sub, cell, counts, keys and checks of both sides)."""
    sub = F.pmod(F.xxhash64("x.d", F.lit(level), F.lit("sub")), F.lit(4**level)).cast("int") if level else F.lit(0)
    tag = lambda c, side: F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(side).alias("side")))
    each = pairs.select("key", "which", F.explode(F.concat(tag("a", True), tag("b", False))).alias("x"))
    d = F.col("x.d")
    each = each.select("key", "which", sub.alias("sub"), F.col("x.side").alias("side"), d.alias("d"), _check(d, level).alias("c"), F.explode(F.array(*(_cell(d, level, k) for k in range(RANGES)))).alias("cell"))
    one = lambda f, v, side: f(F.when(F.col("side") == side, v).otherwise(F.lit(0).cast("long")))
    return each.groupBy("key", "which", "sub", "cell").agg(
        one(F.sum, F.lit(1).cast("long"), True).alias("na"), one(F.bit_xor, F.col("d"), True).alias("ka"), one(F.bit_xor, F.col("c"), True).alias("ca"),
        one(F.sum, F.lit(1).cast("long"), False).alias("nb"), one(F.bit_xor, F.col("d"), False).alias("kb"), one(F.bit_xor, F.col("c"), False).alias("cb"),
    )


def peel(made: DataFrame, level: int) -> DataFrame:
    """Subtracts and peels each sketch: (key, which, found, done); found counts the recovered digests of both sides."""
    cell = F.struct("cell", (F.col("na") - F.col("nb")).alias("n"), F.col("ka").bitwiseXOR(F.col("kb")).alias("k"), F.col("ca").bitwiseXOR(F.col("cb")).alias("c"))
    sketches = made.groupBy("key", "which", "sub").agg(F.collect_list(cell).alias("cells"))  # CELLS entries at most
    start = F.struct(F.col("cells"), F.array().cast("array<bigint>").alias("out"))
    zero = F.lit(0).cast("long")

    def clear(c: Column, pure: Column) -> Column:
        def take(a: Column, p: Column) -> Column:
            hit = (_cell(p["k"], level, 0) == a["cell"]) | (_cell(p["k"], level, 1) == a["cell"]) | (_cell(p["k"], level, 2) == a["cell"])
            return F.when(hit, F.struct(a["cell"].alias("cell"), (a["n"] - p["n"]).alias("n"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["c"].bitwiseXOR(_check(p["k"], level)).alias("c"))).otherwise(a)

        return F.aggregate(pure, c, take)

    def turn(s: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"], level) == c["c"])), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))
        both = F.struct(s["cells"].alias("cells"), s["out"].alias("out"), pure.alias("pure"))
        # a one-entry array binds ``pure`` once for the expressions below
        return F.get(
            F.transform(
                F.array(both),
                lambda b: F.when(F.size(b["pure"]) == 0, F.struct(b["cells"].alias("cells"), b["out"].alias("out"))).otherwise(
                    F.struct(F.transform(b["cells"], lambda c: clear(c, b["pure"])).alias("cells"), F.concat(b["out"], F.transform(b["pure"], lambda p: p["k"])).alias("out"))
                ),
            ),
            F.lit(0),
        )

    peeled = sketches.select("key", "which", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn).alias("p"))
    done = F.forall("p.cells", lambda c: (c["n"] == 0) & (c["k"] == zero) & (c["c"] == zero))
    return peeled.select("key", "which", F.size("p.out").cast("long").alias("found"), done.alias("done")).groupBy("key", "which").agg(F.sum("found").alias("found"), F.min("done").alias("done"))


def _spell(n: str, k: str, c: str) -> Column:
    """A fingerprint as text: cell, count, digests and checks of each cell in use, in order of the cells."""
    return F.concat_ws("-", F.hex("cell"), F.hex(n), F.hex(k), F.hex(c))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, levels."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST_ID)).alias("id"), text_or_empty(docs["text"]).alias("text"))
    d = _with_next(rows)
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next", F.lit(1), half)))
    d = d.select(
        F.monotonically_increasing_id().alias("key"), "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _digests(F.col("text")).alias("a"), _digests(F.col("edited")).alias("e"), _digests(F.col("next")).alias("n"),
    )
    d = materialize(d, "fingerprint-digests")
    dealt = d.repartition("key")  # all aggregations below keep this partitioning
    pairs = dealt.select("key", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("a"), F.col("e").alias("b")), F.struct(F.lit(1).alias("which"), F.col("a"), F.col("n").alias("b")))).alias("p"))
    open_ = pairs.select("key", "p.which", "p.a", "p.b")
    made = cells(open_, 0)
    base = materialize(made, "fingerprint-cells").repartition("key")
    spelled = base.where("which = 0").groupBy("key").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("na") > 0, F.struct("cell", _spell("na", "ka", "ca").alias("s"))))).getField("s"), "/").alias("fa"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("nb") > 0, F.struct("cell", _spell("nb", "kb", "cb").alias("s"))))).getField("s"), "/").alias("fe"),
    )
    results, level, made = [], 0, base
    while True:
        got = materialize(peel(made, level).withColumn("level", F.lit(level)), "fingerprint-peeled")
        results.append(got.where("done"))
        failed = got.where("not done").select("key", "which")
        level += 1
        if level > MOST_LEVELS or failed.isEmpty():
            break
        open_ = d.join(failed, "key").select("key", "which", "a", F.when(F.col("which") == 0, F.col("e")).otherwise(F.col("n")).alias("b"))
        made = cells(open_, level)
    if level > MOST_LEVELS:  # not seen: a check value that fails at every level
        rest = d.join(failed, "key").select("key", "which", F.size(F.array_except("a", F.when(F.col("which") == 0, F.col("e")).otherwise(F.col("n")))).cast("long").alias("x"), F.size(F.array_except(F.when(F.col("which") == 0, F.col("e")).otherwise(F.col("n")), "a")).cast("long").alias("y"))
        results.append(rest.select("key", "which", (F.col("x") + F.col("y")).alias("found"), F.lit(True).alias("done"), F.lit(level).alias("level")))
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    of = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    differ = every.groupBy("key").agg(of(0, "found").alias("de"), of(1, "found").alias("dn"), F.max("level").alias("level"))
    out = d.select("key", "id", "n_chars", "edited_sha256", F.size("a").alias("sa"), F.size("e").alias("se"), F.size("n").alias("sn")).join(differ, "key", "left").join(spelled, "key", "left")

    def near(other: str, differing: str) -> Column:
        both, d = F.col("sa") + F.col(other), F.coalesce(differing, F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d).cast("double"))

    return out.select(
        F.when(F.col("id") != LEAST_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        F.concat_ws("/", F.col("sa").cast("string"), F.when(F.col("fa") != "", F.col("fa"))).alias("fingerprint"), F.concat_ws("/", F.col("se").cast("string"), F.when(F.col("fe") != "", F.col("fe"))).alias("edited_fingerprint"),
        near("se", "de").alias("near_edited"), near("sn", "dn").alias("near_next"), F.coalesce("level", F.lit(0)).alias("level"),
    )
