"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

A document's set has its distinct 5-word shingles (64-bit hashes of the lower-case words; a text with fewer words is one
shingle; a text without words has an empty set, which links with nothing). Documents with equal sets form a class, and only
its least id takes part from then on; so copies never meet.

``bands`` x ``rows`` minima are banded; at similarity 0.75 the chance that a pair shares no band is (1 - 0.75^4)^32 = 5e-6.
Pairs are made in three rounds, none of which emits all pairs of a bucket:

1. every class meets the bucket leader (the least id) with which it shares most bands;
2. where a bucket still has several components, classes outside its largest one meet a few of that one's members;
3. where it still has, classes outside the largest component meet those of other components with which they share one of
   their rarest shingles, which is exact: similar sets always do.

So a bucket of n near copies costs about n pairs, and no link between different components is lost. A pair whose
signatures agree in too few places to be similar is dropped (chance below 1e-9 at 0.75), the rest is confirmed on full sets.

Defined cases: null text has no words; rows with a null id link with nothing, have a null component and are kept; rows of
one id are one node; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow, fresh, materialize, release, temporary

WORDS, BANDS, ROWS = 5, 32, 4
MEMO_WORDS = 250_000
#: Signature places that must agree, of BANDS * ROWS; at similarity 0.75 the mean is 96 and the deviation 4.9.
AGREE = 64
#: Members of a bucket's largest component that the others meet in round 2.
SAMPLES = 6

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_W = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def _end_task() -> None:
    _WORDS.clear()
    release()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set as sorted distinct 64-bit hashes. bytes.lower and bytes.split know A-Z and ASCII blanks only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(WORDS, len(w))):
        h += _mix(w[k : k + n] * _W[k])
    return np.unique(_mix(h))


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.uint64(2**64 - 1))
    for at in range(0, len(h), 2048):
        v = np.multiply.outer(_A, h[at : at + 2048])
        v += _B[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


FINGERPRINT = "doc_id long, n_shingles long, h string, keys array<long>, sig binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                size, full, keys, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    size.append(len(s))
                    if not len(s):
                        full.append(None), keys.append(np.zeros(0, np.int64)), sigs.append(b"")
                        continue
                    full.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    m = minima(s)
                    keys.append(_mix((m.reshape(BANDS, ROWS) * _R).sum(axis=1) + _BAND).view(np.int64))
                    sigs.append((_mix(m) >> np.uint64(56)).astype(np.uint8).tobytes())
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(full, pa.string()), lists, pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "h", "keys", "sig"])
        _end_task()

    return arrow(rows, run, FINGERPRINT)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar. texts: (id, text) of all their nodes; repeated ids may repeat pairs.

    No aggregation follows the joins in their stage, which would bind it to the key v: so adaptive execution may split the
    rows of a leader that a third of all pairs has.
    """
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    rows = pairs.join(one, "u").join(two, "v").select("u", "v", "tu", "tv")

    def run(batches):
        last, known = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                us, vs, ok = part.column(0), part.column(1), []
                for tu, tv in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if tv != last:  # a leader's rows follow one another
                        last, known = tv, shingles(tv)
                    ok.append(_similar(shingles(tu), known, percent))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([us.filter(mask), vs.filter(mask)], names=["u", "v"])
        _end_task()

    return arrow(rows, run, "u long, v long")


def _agree(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Signature verification, JVM-side: pairs of fitting sizes whose signatures agree in AGREE places at least."""
    one = marks.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    two = marks.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    rows = pairs.join(one, "u").join(two, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    place = F.sequence(F.lit(1), F.lit(BANDS * ROWS))
    same = F.size(F.filter(place, lambda i: F.substring("su", i, F.lit(1)) == F.substring("sv", i, F.lit(1))))
    return rows.where(same >= AGREE).select("u", "v")


def _proven(pairs: DataFrame, marks: DataFrame, texts: DataFrame, percent: int, name: str) -> DataFrame:
    with temporary(pairs.sparkSession):
        return materialize(confirm(materialize(_agree(pairs, marks, percent), f"{name}-pairs"), texts, percent), f"{name}-links", keep=True)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _open_rows(shared: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of buckets with several components: key, id, component c, the bucket's largest component and whether c is another."""
    placed = materialize(shared.select("key", "id").join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "placed")
    inside = placed.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("most"), F.count("*").alias("n"))
    open_ = materialize(inside.where("n > 1").select("key", F.col("most.c").alias("major")), "open-buckets")
    return materialize(placed.join(open_, "key").select("key", "id", "c", "major", (F.col("c") != F.col("major")).alias("minor")), "open-rows")


def _sampled(rows: DataFrame) -> DataFrame:
    """Round 2: each class outside a bucket's largest component meets SAMPLES members of that, in one bucket for each such component."""
    members = rows.where("not minor").groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(SAMPLES)))).alias("v"))
    chosen = rows.where("minor").groupBy("id", "major").agg(F.min_by("key", F.xxhash64("key")).alias("key"))
    met = chosen.select("key", F.col("id").alias("u")).join(materialize(members, "bucket-members"), "key").select("u", F.explode("v").alias("v"))
    return _ordered(met).where("u <> v").distinct()


def _by_prefix(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Round 3, exact for all pairs of open rows: of two similar sets, the rarest few shingles (in one order for all) share one.

    A class far from its bucket's others has many shingles of its own before any shared one, so its places rule the others out.
    """
    nodes = materialize(rows.groupBy("id").agg(F.first("c").alias("c"), F.max("minor").alias("minor")), "open-nodes")

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingles(t).view(np.int64) for t in b.column(1).slice(at, 256).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "s"])
        _end_task()

    sets = materialize(arrow(texts.join(nodes.select("id"), "id", "left_semi"), cut, "id long, s array<long>"), "open-sets")
    each = sets.select("id", F.explode("s").alias("s"))
    often = materialize(each.groupBy("s").agg(F.count("*").alias("f")), "shingle-counts")
    ranked = each.join(often, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))  # one document's shingles
    prefix = ranked.select("id", F.size("l").alias("n"), F.posexplode(F.expr(f"slice(l, 1, cast(size(l) - ceil(size(l) * {percent} / 100.0) + 1 as int))")).alias("p", "x"))
    prefix = materialize(prefix.where("x.f > 1").select("id", "n", "p", F.col("x.s").alias("s")).join(nodes, "id"), "prefixes")
    a = prefix.where("minor").select("s", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("c").alias("cu"))
    b = prefix.select("s", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("p").alias("pv"), F.col("c").alias("cv"), "minor")
    # if this is their first common shingle, what follows must be enough: common >= percent / (100 + percent) of both sizes
    enough = f"least(nu - pu, nv - pv) * {100 + percent} >= (nu + nv) * {percent}"
    met = a.join(b, "s").where(f"cu <> cv and (not minor or u > v) and least(nu, nv) * 100 >= greatest(nu, nv) * {percent} and {enough}")
    return _ordered(met).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), kept (the row is its component's least)."""
    with temporary(docs.sparkSession):
        return _near_duplicates(docs, percent)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    fp = materialize(fingerprints(docs), "fingerprints", keep=True)
    real = fp.where("h is not null and doc_id is not null")
    classes = materialize(real.groupBy("h").agg(F.min("doc_id").alias("id")), "classes")
    mine = real.select(F.col("h").alias("h2"), "doc_id", "n_shingles", "keys", "sig")
    reps = materialize(classes.join(mine, (F.col("id") == F.col("doc_id")) & (F.col("h") == F.col("h2"))).select("id", F.col("n_shingles").alias("n"), "keys", "sig"), "representatives")
    bands = reps.select("id", F.explode("keys").alias("key"))
    buckets = materialize(bands.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader"), "buckets")
    shared = materialize(bands.join(buckets, "key").select("key", "id", "leader"), "shared-bands")
    marks = reps.select("id", "n", "sig")
    nodes = shared.select("id").distinct()
    raw = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    texts = materialize(raw.join(nodes, "id", "left_semi"), "candidate-texts")

    votes = shared.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("k"))
    first = votes.groupBy("id").agg(F.max(F.struct("k", (-F.col("leader")).alias("less"))).alias("best")).select(F.col("id").alias("u"), (-F.col("best.less")).alias("v"))
    first = materialize(first, "first-pairs")
    links = _proven(first, marks, texts, percent, "first")
    label = materialize(components(links), "first-components")

    rows = _open_rows(shared, label)
    if not rows.isEmpty():
        more = _proven(_sampled(rows).join(_ordered(first), ["u", "v"], "left_anti"), marks, texts, percent, "second")
        links = links.unionByName(more)
        label = materialize(components(links), "second-components")
        rows = _open_rows(shared, label)
    if not rows.isEmpty():
        more = _proven(_by_prefix(rows, texts, percent), marks, texts, percent, "third")
        label = materialize(components(links.unionByName(more)), "components")

    final = materialize(classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("h", F.coalesce("component", "id").alias("component_id")), "class-components", keep=True)
    linked = real.select("doc_id", "n_shingles", "h").join(final, "h").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = fp.where("h is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


#: Up to so many ids are broadcast; beyond, they are joined by shuffle.
FEW_IDS = 100_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Docs whose id isn't in ``gone`` (doc_id), with the same columns; of the rows of one id one stays."""
    columns = docs.columns
    if gone.limit(FEW_IDS + 1).count() <= FEW_IDS:
        gone = F.broadcast(gone)
    return _one_each(docs.join(gone, "doc_id", "left_anti")).select(*columns)


def _one_each(docs: DataFrame) -> DataFrame:
    """Drops repeated rows of one id. Ids that repeat are found by a count over the ids alone, so other rows aren't shuffled."""
    h, n = fresh(docs, "h"), fresh(docs, "n")
    everything = F.xxhash64(*(docs[c] for c in docs.columns))
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n), F.min(everything).alias(h)).where(F.col(n) > 1).select("doc_id", h), "repeated-ids")
    if twice.isEmpty():
        return docs
    if twice.limit(FEW_IDS + 1).count() <= FEW_IDS:
        twice = F.broadcast(twice)
    rows = docs.join(twice, "doc_id", "left")
    single = rows.where(F.col(h).isNull()).drop(h)
    least = rows.where(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)) == F.col(h)).drop(h)
    return single.unionByName(least.dropDuplicates(["doc_id"]))
