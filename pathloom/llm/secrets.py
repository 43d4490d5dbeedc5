"""Secret scans by two character Markov models, in DataFrame functions only.

Three patterns give the base spans. What is left between them is cut into runs of at least ``MIN_RUN`` characters of the base64
alphabet; each run is scored by the log-likelihood ratio of two first-order character models, one of random strings and one of
ordinary identifiers, and runs above the threshold are added as kind ``markov``. A run ends at a base span, so the parts before
and after one are scored too (but hexadecimal digits and capitals that lead into a span of another kind go with it).

The models are trained from labelled samples: random are the values of base spans and generated hashes in the usual
alphabets, ordinary the words outside base spans. The corpus part of the sample is bounded (about ``sample_docs`` documents by
a hash of their ids, whole texts); what reaches the driver are two tables of at most 96 x 96 counts.

Positions are code points, found by lengths alone: a text is the alternation of the gaps that ``split`` gives and the matches
that ``regexp_extract_all`` gives for the same pattern. Sums of lengths are made in two levels, a text with spans taken out is
joined from its pieces, and a run is split into characters once, so the work grows with the text, however many matches it has
and however long they are.

Defined cases: null text is empty; an empty table gives no rows and models from generated strings alone; repeated rows are
each scanned; touching spans become one mark; U+0001, which stands for what spans held, is taken for U+0002 in a text that has
it; extra columns, whatever their names, are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_share, text_or_empty

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Cheaper patterns with the same long matches: a greedy run is maximal, so short runs only lose.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
MIN_RUN, SYMBOLS = 16, 96
RUN = "[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
KINDS = ("assign", "access", "hex", "markov")
#: Stands for each character of a span already found; what of the next kinds touches one goes with it.
GONE = "\x01"
ACCESS_LEFT, HEX_LEFT = f"{ACCESS_LONG}|AKIA[A-Z0-9]*(?={GONE})", f"{HEX_LONG}|(?<={GONE})[0-9a-f]+|[0-9a-f]+(?={GONE})"
PIECES = "array<struct<g:string,h:string,v:string,ok:boolean>>"
#: Lengths summed at a time.
CHUNK = 256


def _pieces(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text as gaps g and leftmost matches h (null after the last gap), with the group's value and whether it is long enough."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(gaps.alias("g"), hits.alias("h"), values.alias("v"))
    every = F.transform(zipped, lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), x["v"].alias("v"), F.coalesce(F.length(x["v"]) >= least, F.lit(False)).alias("ok")))
    return F.when(F.regexp_like(text, F.lit(pattern)), every.cast(PIECES)).otherwise(F.array().cast(PIECES))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: lambdas would compute it again for each entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(lengths: Column) -> Column:
    """The sum of the lengths before each place."""

    def running(a: Column) -> Column:  # one entry more
        return F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.get(s, F.size(s) - 1) + x)))

    def chunks(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / CHUNK).cast("int")), lambda k: running(F.slice(n, k * CHUNK + 1, F.lit(CHUNK))))

    def joined(c: Column) -> Column:
        before = running(F.transform(c, lambda x: F.get(x, F.size(x) - 1)))
        return F.flatten(F.zip_with(F.concat(c, F.array(F.array(F.lit(0)))), before, lambda x, b: F.transform(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda y: y + b)))

    return _let(lengths, lambda n: _let(chunks(n), joined))


def _spans(pieces: Column, kind: int) -> Column:
    """(start, kind, end) of the matches that are long enough."""
    at = _sums(F.transform(pieces, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))))
    found = F.zip_with(pieces, at, lambda x, a: F.struct((a + F.length(x["g"])).alias("s"), F.lit(kind).alias("k"), (a + F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("e"), x["ok"].alias("ok")))
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return F.when(F.size(pieces) > 0, kept).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _without(text: Column, pieces: Column) -> Column:
    """The text with each character of the matches that count replaced."""
    joined = F.array_join(F.transform(pieces, lambda x: F.concat(x["g"], F.when(x["ok"], F.repeat(F.lit(GONE), F.length(x["h"]))).otherwise(F.coalesce(x["h"], F.lit(""))))), "")
    return F.when(F.exists(pieces, lambda x: x["ok"]), joined).otherwise(text)


def _base(rows: DataFrame) -> DataFrame:
    """(text, ..) -> also the pieces of each kind, a, k and h, and what is left of the text, rest."""
    d = rows.withColumn("text", F.translate("text", GONE, "\x02")).withColumns({"a": _pieces(F.col("text"), ASSIGN, 2, 8), "k": _pieces(F.col("text"), ACCESS_LONG), "h": _pieces(F.col("text"), HEX_LONG)})
    d = d.withColumn("rest", _without(F.col("text"), F.col("a")))
    for kind, pattern in (("k", ACCESS_LEFT), ("h", HEX_LEFT)):
        d = d.withColumn("rest", F.when(F.size(kind) > 0, _without(F.col("rest"), _pieces(F.col("rest"), pattern))).otherwise(F.col("rest")))
    return d


def _code(c: Column) -> Column:
    return F.when((F.ascii(c) >= 33) & (F.ascii(c) < 127), F.ascii(c) - 32).otherwise(0)


def _codes(v: Column) -> Column:
    return F.transform(F.split(v, ""), _code)


def _pairs(strings: DataFrame) -> DataFrame:
    """(v) -> counts (i, j, n) of neighbouring characters; at most SYMBOLS squared rows."""
    coded = strings.where(F.length("v") >= 2).select(_codes(F.col("v")).alias("c"))
    both = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * SYMBOLS + b)
    return coded.select(F.explode(both).alias("p")).groupBy("p").agg(F.count("*").alias("n")).select(F.floor(F.col("p") / SYMBOLS).cast("int").alias("i"), (F.col("p") % SYMBOLS).alias("j"), "n")


def generated(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled random strings in the usual alphabets, from hashes."""
    h = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(h))
    kinds = (h, b64, F.translate(b64, "+/=", "-_"), F.upper(F.translate(b64, "+/=", "")), F.substring(F.translate(b64, "+/=", ""), 1, 24))
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("v"))


def fit(docs: DataFrame, sample_docs: int = 4000, smooth: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of characters, row by row."""
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    sample = _base(d.where(in_share("doc_id", sample_docs / max(1, d.count()))).select("text"))
    values = sample.select(F.explode(F.concat("a", "k", "h")).alias("x")).where("x.ok").select(F.col("x.v").alias("v"))
    words = sample.select(F.explode(F.regexp_extract_all("rest", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("v"))
    counts = []
    for strings in (values.unionByName(generated(spark)), words):
        c = [[smooth] * SYMBOLS for _ in range(SYMBOLS)]
        for r in _pairs(strings).collect():
            c[r.i][r.j] += r.n
        counts.append([[math.log(x / sum(row)) for x in row] for row in c])
    random, ordinary = counts
    return [random[i][j] - ordinary[i][j] for i in range(SYMBOLS) for j in range(SYMBOLS)]


def scan(rows: DataFrame, ratios: list[float], threshold: float = 12.0, mean: float = 0.35) -> DataFrame:
    """(text, ..), no null text -> also base and spans (arrays of start, kind, end; the latter with the models' spans) and rest,
    the text with each character of a span replaced."""
    ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def llr(v: Column) -> Column:
        return _let(_codes(v), lambda c: F.aggregate(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(ratio, a * SYMBOLS + b)), F.lit(0.0), lambda s, x: s + x))

    d = _base(rows).withColumn("m", _pieces(F.col("rest"), RUN, 0, MIN_RUN))
    judged = F.transform("m", lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), x["v"].alias("v"), (x["ok"] & (llr(x["v"]) >= F.greatest(F.lit(threshold), F.length(x["v"]) * mean))).alias("ok")))
    d = d.withColumn("m", F.when(F.size("m") > 0, judged).otherwise(F.col("m")))
    d = d.withColumn("base", F.sort_array(F.concat(*(_spans(F.col(c), k) for k, c in enumerate("akh")))))
    d = d.withColumn("more", _spans(F.col("m"), 3)).withColumn("rest", _without(F.col("rest"), F.col("m")))
    return d.withColumn("spans", F.when(F.size("more") > 0, F.sort_array(F.concat("base", "more"))).otherwise(F.col("base"))).drop("a", "k", "h", "m", "more")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, ratios: list[float], **how) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    d = scan(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text")), ratios, **how)
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), n(3).alias("n_markov"))


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]", **how) -> DataFrame:
    """The same columns, each secret in ``text`` replaced by a mark and n_chars, where it exists, counted anew."""
    kept = [docs[c] for c in docs.columns]
    d = scan(docs.select(F.struct(*kept).alias("row"), text_or_empty(docs["text"]).alias("text")), ratios, **how)
    d = d.select("row", (F.size("spans") > 0).alias("changed"), F.when(F.size("spans") > 0, F.regexp_replace("rest", f"{GONE}+", mark)).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "int"))}
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return d.select(*(F.when(F.col("changed"), new[c]).otherwise(v).alias(c) if c in new else v.alias(c) for c, v in old.items()))
