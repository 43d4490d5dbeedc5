"""Audit of five filters in all their orders, with duplicates found by partition refinement.

The filters: A under 50 words; B fewer than 65 different words in 100; C over 5 capitals in 100 code points; D any of
``#$%&*|``; E the same text as a document with a smaller id, in the whole table. One scan gives each document the mask of A to
D, its length in code points, and a chain of hashes: of the first block of its bytes, then with each next block, 16 times as
long as the one before.

Duplicates: the rows are split by length, then by the first hash of the chain, the second and so on; what is alone in its part
is dropped each time, and what has no further block is finished. Of parts that are left the full texts are compared: a second
scan takes the texts whose last hash may be among them (a bitmap of fixed size; whatever it lets through in error is right,
only more work), groups them by the text itself and takes the least id of each. Where texts that differ share all hashes, that
part's rows are read once more and matched by text. Rows with an id above their text's least fail E. Joins are plain
equi-joins with written tables, so adaptive execution splits the rows of a large group of copies.

Then only (source, mask) counts are left, 32 for each source, and all 120 orders of 5 steps follow from them.

Defined cases: null text is empty; empty texts are copies of each other; a null id is neither smaller nor greater than another;
rows that repeat an id are documents of their own and no duplicates of each other; of several labels of an id any 1 counts;
null source is the empty one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow, materialize, temporary

FILTERS = "ABCDE"
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of the first block; each next one is so many times as long.
FIRST, GROWTH = 1024, 16
#: Words of 64 bits in the bitmap.
BITMAP = 1 << 18
STRIDE = 1 << 20


def mask(text: bytes, n_chars: int) -> int:
    """Of the failing conditions A (1) to D (8). Long texts are cut at blanks, so no list of all their words is made."""
    words, n, at = set(), 0, 0
    while at < len(text):
        cut = BLANK.search(text, at + STRIDE) if len(text) - at > STRIDE else None
        end = cut.start() if cut else len(text)
        found = text[at:end].split()  # of bytes: at \x20 and \x09 to \x0D
        n += len(found)
        words.update(found)
        at = end
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (n < 50) | (100 * len(words) < 65 * n) << 1 | (100 * capitals > 5 * n_chars) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def chain(text: bytes, n_chars: int, bits: int = 64) -> list[int]:
    """The hash of the first block (with both lengths), and of each next one with the hash before it."""
    out, at, size, last = [], 0, FIRST, b"%d/%d" % (n_chars, len(text))
    while at < len(text) or not out:
        last = blake2b(memoryview(text)[at : at + size], digest_size=8, salt=blake2b(last, digest_size=16).digest()).digest()
        if bits < 64:
            last = (int.from_bytes(last, "little") >> (64 - bits)).to_bytes(8, "little")
        out.append(int.from_bytes(last, "little", signed=True))
        at, size = at + size, size * GROWTH
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.length(text).alias("n_chars"), text.cast("binary").alias("text"))


def _facts(docs: DataFrame, bits: int) -> DataFrame:
    """Per document: doc_id, part, mask, n_chars, chain."""

    def run(batches):
        for b in batches:
            lengths, texts = b.column(2).to_pylist(), b.column(3)
            masks, chains = [], []
            for n, t in zip(lengths, texts, strict=True):
                t = t.as_py()
                masks.append(mask(t, n))
                chains.append(chain(t, n, bits))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), b.column(2), pa.array(chains, pa.list_(pa.int64()))], names=["doc_id", "part", "mask", "n_chars", "chain"])

    return arrow(_rows(docs), run, "doc_id long, part string, mask int, n_chars int, chain array<long>")


def _texts(docs: DataFrame, classes: DataFrame, bits: int):
    """doc_id, part, mask, class, text of the documents whose last hash may be in ``classes``; the broadcast bitmap."""
    spark = docs.sparkSession
    bit = F.expr("shiftleft(1L, cast(class & 63 as int))")
    words = classes.groupBy(F.pmod(F.shiftright("class", 6), F.lit(BITMAP)).alias("w")).agg(F.bit_or(bit).alias("b")).collect()  # BITMAP rows at most
    bitmap = np.zeros(BITMAP, np.int64)
    for w, b in words:
        bitmap[w] = b
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        seen = shared.value
        for b in batches:
            ids, sources, lengths, column = *(b.column(k).to_pylist() for k in range(3)), b.column(3)
            out: list[list] = [[], [], [], [], []]
            for k, n in enumerate(lengths):
                t = column[k].as_py()
                c = chain(t, n, bits)[-1]
                if int(seen[(c >> 6) % BITMAP]) >> (c & 63) & 1:
                    for to, v in zip(out, (ids[k], sources[k], mask(t, n), c, t), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "part", "mask", "class", "text"])

    return arrow(_rows(docs), run, "doc_id long, part string, mask int, class long, text binary"), shared


def refine(facts: DataFrame) -> DataFrame:
    """(n_chars, chain) -> (class), the last hashes that more than one row has, found by splitting part after part.

    A round keeps only the keys of parts with more rows than one. The next one's rows are those whose hash before it is among
    them: a hash holds all before it, so what was dropped in an earlier round stays out.
    """

    def parts(rows: DataFrame, key: Column, k: int) -> DataFrame:
        n = F.size("chain")
        found = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.max(n == k).alias("done"), F.max(n > k).alias("more"))
        return materialize(found.where("n > 1").select("key", "done", "more"), "audit-parts", keep=True)

    hashes = facts.select(F.col("n_chars").cast("long").alias("n_chars"), "chain")
    with temporary(facts.sparkSession):
        now, before, k, found = parts(hashes, F.col("n_chars"), 0), F.col("n_chars"), 0, []
        while not now.where("more").isEmpty():
            left = hashes.withColumn("before", before).join(now.where("more").select(F.col("key").alias("before")), "before", "left_semi")
            now, before = parts(left.where(F.size("chain") > k), F.get("chain", F.lit(k)), k + 1), F.get("chain", F.lit(k))
            k += 1
            found.append(now.where("done").select(F.col("key").alias("class")))
        if not found:
            return now.select(F.col("key").alias("class")).limit(0)
        for other in found[1:]:
            found[0] = found[0].unionByName(other)
        return found[0]


def _masks(docs: DataFrame, bits: int) -> DataFrame:
    """See ``failing``; reads tables of the ``temporary`` block that is open."""
    facts = materialize(_facts(docs, bits), "audit-facts")
    texts, bitmap = _texts(docs, refine(facts), bits)
    with temporary(docs.sparkSession):
        least = materialize(texts.groupBy("class", "text").agg(F.min("doc_id").alias("least")).select("class", "least"), "audit-texts", keep=True)
    bitmap.destroy()
    mixed = materialize(least.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "audit-mixed")
    facts = facts.select("doc_id", "part", "mask", F.element_at("chain", -1).alias("class"))
    if mixed.isEmpty():
        out = facts.join(least, "class", "left")
    else:  # different texts with the same hashes
        texts, bitmap = _texts(docs, mixed, bits)
        texts = materialize(texts.join(mixed, "class", "left_semi"), "audit-mixed-texts")
        bitmap.destroy()
        each = materialize(texts.groupBy("class", "text").agg(F.min("doc_id").alias("least")), "audit-mixed-least")
        out = facts.join(mixed, "class", "left_anti").join(least, "class", "left").unionByName(texts.join(each, ["class", "text"]).drop("text"))
    return out.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).cast("int").alias("mask"))


def failing(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per document: doc_id, part, mask (E is 16). ``bits``: of the hashes, fewer only in tests."""
    with temporary(docs.sparkSession):
        return materialize(_masks(docs, bits), "audit-masks", keep=True)


def counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask) -> n, good, toxic."""
    one = lambda c: F.max((labels[c].cast("int") == 1).cast("int")).alias(c)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"], labels["toxic"]).groupBy("doc_id").agg(one("quality"), one("toxic"))
    known = materialize(known.where("doc_id is not null and (quality = 1 or toxic = 1)"), "audit-labels")
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), flag("quality").alias("good"), flag("toxic").alias("toxic"))


def audit(by_mask: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) -> a row for each part, order of the filters and step."""
    held = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 entries at most
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    d = held.select("part", "m", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("k", "letter"))
    bit = lambda c: F.pow(F.lit(2), F.position(c, F.lit(FILTERS)) - 1).cast("int")
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + bit(x))
    d = d.withColumns({"bit": bit(F.col("letter")), "before": before})
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) > 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) > 0
    total = lambda which, of="n": F.aggregate(F.filter("m", which), F.lit(0).cast("long"), lambda s, x: s + x[of])
    here = lambda x: fails(x) & ~gone(x)
    share = F.aggregate(F.filter("m", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.floor(F.lit(120) / F.bit_count(x["mask"])).cast("long"))
    return d.select(
        "part", "filter_order", (F.col("k") + 1).cast("int").alias("step"), total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(here).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    with temporary(docs.sparkSession):
        by_mask = materialize(counts(_masks(docs, 64), labels), "audit-counts", keep=True)
    return audit(by_mask)
