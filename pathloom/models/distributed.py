"""Training over tables: profiles and their triplets never leave Spark, whatever their number.

A profile is a row with its triplets, its heads and their moments; rows are dealt into blocks of about ``block`` profiles. In an
epoch tasks go through many blocks as they come: each draws its positives and negatives (by a generator seeded with seed, epoch and
block), works out the loss and its gradients, moves its own profiles' heads, and adds the gradients of the networks to the task's, which
are handed on once. Those are added up by network with a plain aggregation, as whole numbers, so no order of adding changes them; only the networks' vectors, as many as there are networks, are
the driver's, and go to the tasks with the job. So an epoch is one step with the mean gradient of all blocks.

The loss has four parts: margins between each head's own positives (others with a chance of ``leak``) and all negatives, weighted by the
triplets' weights; hop order of the positives; pull and push of pairs of profiles by the affinity of their fingerprints, on their
Chamfer distance; and the spread of a profile's heads. In the ball, steps are Adam's in the tangent space, followed along geodesics; in the plane they are AdamW's.

Each epoch is finished by one small file; a run that was stopped goes on after the last finished epoch. The best and the last
tables stay, earlier ones are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..storage import shared_dir, stored
from .embed import EPS, distance, inside

UNIT = float(1 << 32)  # gradients and losses are added up in these parts


@dataclass
class Config:
    dim: int = 24
    heads: int = 2
    geometry: str = "hyperbolic"
    epochs: int = 60
    positives: int = 16
    negatives: int = 48
    margin: float = 1.0
    leak: float = 0.2
    rank_weight: float = 0.2
    sim_weight: float = 0.1
    sim_margin: float = 4.0
    diversity: float = 0.01
    decay: float = 0.01
    rate: float = 0.02
    patience: int = 10
    stop_after: int = 25
    block: int = 512
    seed: int = 1


def move(v: np.ndarray, step: np.ndarray, geometry: str) -> np.ndarray:
    """The end of the geodesic from ``v`` with the tangent ``step``."""
    if geometry == "euclidean":
        return v + step
    n = np.maximum(np.linalg.norm(step, axis=-1, keepdims=True), 1e-15)
    y = np.tanh(n / np.maximum(1 - (v * v).sum(-1, keepdims=True), EPS)) * step / n
    xy, xx, yy = (v * y).sum(-1, keepdims=True), (v * v).sum(-1, keepdims=True), (y * y).sum(-1, keepdims=True)
    return inside(((1 + 2 * xy + yy) * v + (1 - xx) * y) / np.maximum(1 + 2 * xy + xx * yy, 1e-15), geometry)


def adam(v: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray, t: int, rate: float, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step: v, m and s (one number for each vector) after it."""
    if cfg.geometry != "euclidean":
        g = g * ((1 - (v * v).sum(-1, keepdims=True)) ** 2 / 4)
    m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * (g * g).sum(-1, keepdims=True)
    step = -rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    if cfg.geometry == "euclidean":
        v = v * (1 - rate * cfg.decay)
    return move(v, step, cfg.geometry), m, s


def block_loss(h: np.ndarray, a: np.ndarray, pos: np.ndarray, hop: np.ndarray, weight: np.ndarray, neg: np.ndarray, own: np.ndarray, pair: np.ndarray | None, affinity: np.ndarray | None, cfg: Config) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """h (profiles, heads, dim), a (networks, dim); pos, hop, weight (profiles, m), neg (profiles, n): places of networks. own: which heads a
    positive pulls besides the nearest; pair: each profile's partner. -> loss, gradients of h, and (places, gradients) of networks."""
    b, k, _ = h.shape
    gh, where, ga = np.zeros_like(h), [], []
    dp, hp, ap = distance(h[:, :, None], a[pos][:, None], cfg.geometry)  # (b, k, m)
    dn, hn, an = distance(h[:, :, None], a[neg][:, None], cfg.geometry)
    nearest = dp.argmin(1)
    mask = (own | (np.arange(k)[None, :, None] == nearest[:, None])) * (weight / (weight.mean() + 1e-9))[:, None]
    raw = dp[..., None] - dn[:, :, None, :] + cfg.margin
    on = raw > 0
    z = mask.sum() + 1e-9
    loss = float((np.where(on, raw, 0).sum(-1) * mask).sum() / z)
    cp, cn = mask * on.sum(-1) / z, -(mask[..., None] * on).sum(2) / z
    # nearer networks come first
    least = np.take_along_axis(dp, nearest[:, None], 1)[:, 0]
    first = hop[:, :, None] < hop[:, None, :]
    late = least[:, :, None] - least[:, None, :] + 0.1 * cfg.margin
    bad, pairs = first & (late > 0), first.sum() + 1e-9
    loss += cfg.rank_weight * float(np.where(bad, late, 0).sum() / pairs)
    cr = cfg.rank_weight * (bad.sum(2) - bad.sum(1)) / pairs
    np.put_along_axis(cp, nearest[:, None], np.take_along_axis(cp, nearest[:, None], 1) + cr[:, None], 1)
    for c, by_h, by_a, at in ((cp, hp, ap, pos), (cn, hn, an, neg)):
        gh += (c[..., None] * by_h).sum(2)
        where.append(at.ravel())
        ga.append((c[..., None] * by_a).sum(1).reshape(-1, a.shape[1]))
    if pair is not None and cfg.sim_weight:
        d, by_x, by_y = distance(h[:, :, None], h[pair][:, None], cfg.geometry)  # (b, heads, partner's heads)
        near = np.zeros_like(d)
        r, q = np.arange(b)[:, None], np.arange(k)[None]
        np.add.at(near, (r, q, d.argmin(2)), 0.5 / k)
        np.add.at(near, (r, d.argmin(1), q), 0.5 / k)
        chamfer = (near * d).sum((1, 2))
        push = np.maximum(cfg.sim_margin - chamfer, 0)
        loss += cfg.sim_weight * float((affinity * chamfer**2 + (1 - affinity) * push**2).mean())
        c = (cfg.sim_weight * 2 * (affinity * chamfer - (1 - affinity) * push) / b)[:, None, None] * near
        gh += (c[..., None] * by_x).sum(2)
        np.add.at(gh, pair, (c[..., None] * by_y).sum(1))
    if cfg.diversity and k > 1:
        i, j = np.triu_indices(k, 1)
        d, by_i, by_j = distance(h[:, i], h[:, j], cfg.geometry)
        e = np.exp(-d)
        loss += cfg.diversity * float(e.mean())
        c = (-cfg.diversity * e / e.size)[..., None]
        for t, (x, y) in enumerate(zip(i, j, strict=True)):
            gh[:, x] += c[:, t] * by_i[:, t]
            gh[:, y] += c[:, t] * by_j[:, t]
    return loss, gh, np.concatenate(where), np.concatenate(ga)


def affinity(lo: np.ndarray, hi: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 from 64 different bits on."""
    u = lambda x: x.astype(np.int64).view(np.uint64)
    lo, hi = u(lo), u(hi)
    return np.maximum(0.0, 1 - (np.bitwise_count(lo ^ lo[pair]) + np.bitwise_count(hi ^ hi[pair])).astype(np.float64) / 64)


ROW = "block int, pid long, ids array<int>, hops array<int>, weights array<double>, lo long, hi long, heads array<double>, m array<double>, s array<double>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows that come in order of their blocks, block by block."""
    held, now = [], None
    for b in batches:
        block = b.column("block").to_numpy()
        for i, j in pairwise([0, *np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else []):
            if held and now != block[i]:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(block[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def _epoch(block: int, rows: pa.Table, a: np.ndarray, epoch: int, rate: float, share: float, prints: bool, cfg: Config) -> tuple[int, dict[str, pa.Array], np.ndarray, np.ndarray]:
    """-> the block's loss, the columns that it changes, and the places of its networks and their gradients."""
    rng, b = np.random.default_rng([cfg.seed, epoch, block]), rows.num_rows
    column = lambda c: rows.column(c).chunk(0)
    flat = lambda c: column(c).flatten().to_numpy()
    stack = lambda c, *shape: flat(c).reshape(b, *shape).astype(np.float64)
    h, m, s = stack("heads", cfg.heads, cfg.dim), stack("m", cfg.heads, cfg.dim), stack("s", cfg.heads, 1)
    n = column("ids").value_lengths().to_numpy().astype(np.int64)
    draw = (np.cumsum(n) - n)[:, None] + (rng.random((b, cfg.positives)) * n[:, None]).astype(np.int64)
    pos, hop, weight = (flat(c)[draw] for c in ("ids", "hops", "weights"))
    neg = rng.integers(0, len(a), (b, cfg.negatives))
    own = rng.random((b, cfg.heads, cfg.positives)) < cfg.leak
    pair = rng.permutation(b) if prints else None
    near = affinity(column("lo").to_numpy(), column("hi").to_numpy(), pair) if prints else None
    loss, gh, at, ga = block_loss(h, a, pos, hop, weight, neg, own, pair, near, cfg)
    h, m, s = adam(h, gh * share, m, s, epoch + 1, rate, cfg)
    seen, place = np.unique(at, return_inverse=True)
    sums = np.stack([np.bincount(place, g, len(seen)) for g in (ga * share).T], axis=1)  # of the block's networks, however many there are
    return round(loss * UNIT), {"heads": _lists(h.reshape(b, -1)), "m": _lists(m.reshape(b, -1)), "s": _lists(s.reshape(b, -1))}, seen, np.rint(sums * UNIT).astype(np.int64)


#: Profiles that one task may hold.
FEW_PROFILES = 4_096
#: Gradients in one batch of what a task hands on.
GRADIENTS = 20_000


def _job(a: np.ndarray, epoch: int, rate: float, share: float, prints: bool, cfg: Config):
    kinds = {"block": pa.int32(), "pid": pa.int64(), "ids": pa.list_(pa.int32()), "hops": pa.list_(pa.int32()), "weights": pa.list_(pa.float64()), "lo": pa.int64(), "hi": pa.int64()}
    kinds |= {c: pa.list_(pa.float64()) for c in ("heads", "m", "s")} | {"asn": pa.int32(), "loss": pa.int64(), "grad": pa.list_(pa.int64())}

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(a.shape, np.int64), np.zeros(len(a), bool)
        for block, rows in _blocks(batches):
            loss, made, at, g = _epoch(block, rows, a, epoch, rate, share, prints, cfg)
            sums[at] += g
            seen[at] = True
            b = rows.num_rows
            kept = {c: rows.column(c).chunk(0) for c in rows.column_names if c not in made}
            yield batch(b, kept | made | {"asn": pa.array(np.full(b, -1, np.int32)), "loss": pa.array([loss] + [0] * (b - 1), pa.int64())})
        at = np.flatnonzero(seen)
        for k in range(0, len(at), GRADIENTS):
            i = at[k : k + GRADIENTS]
            yield batch(len(i), {"asn": pa.array(i.astype(np.int32)), "loss": pa.array(np.zeros(len(i), np.int64)), "grad": _lists(sums[i])})

    return run


def _profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of a finished epoch, whose table has the tasks' gradients too."""
    return spark.read.schema(f"{ROW}, asn int").parquet(path).where("coalesce(asn, -1) = -1").drop("asn")


def _dealt(triplets: DataFrame, prints: DataFrame | None, ids: DataFrame, cfg: Config) -> tuple[DataFrame, int, int]:
    """A row for each profile, dealt into blocks; the numbers of blocks and profiles."""
    t = triplets.join(ids, "asn").groupBy(F.col("profile").alias("pid")).agg(F.sort_array(F.collect_list(F.struct("id", "hop", "weight"))).alias("t"))  # of one profile: its networks
    t = t.select("pid", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["hop"].cast("int")).alias("hops"), F.transform("t", lambda x: x["weight"].cast("double")).alias("weights"))
    t = t.join(prints.select("pid", "lo", "hi"), "pid", "left") if prints is not None else t.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")})
    t = stored(t.na.fill(0, ["lo", "hi"]), "training-profiles")
    n = t.count()
    blocks = max(1, -(-n // cfg.block))
    return t.withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")), blocks, n


def _heads(pids: Iterable[int], cfg: Config) -> np.ndarray:
    scale = 0.05 if cfg.geometry == "euclidean" else 0.01
    return np.stack([np.random.default_rng([cfg.seed, 1 << 20, p & 0xFFFFFFFF, p >> 32 & 0x7FFFFFFF]).normal(0, scale, cfg.heads * cfg.dim) for p in pids])


def _networks(n: int, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = inside(np.random.default_rng([cfg.seed, 1 << 21]).normal(0, (0.2 if cfg.geometry == "euclidean" else 0.5) / np.sqrt(cfg.dim), (n, cfg.dim)), cfg.geometry)
    return a, np.zeros_like(a), np.zeros((n, 1))


def _start(triplets: DataFrame, prints: DataFrame | None, ids: DataFrame, cfg: Config) -> tuple[DataFrame, int]:
    t, blocks, _ = _dealt(triplets, prints, ids, cfg)

    def heads(batches):
        for b in batches:
            made = list(_heads(b["pid"], cfg)) if len(b) else []
            yield b.assign(heads=made, m=[np.zeros(cfg.heads * cfg.dim) for _ in made], s=[np.zeros(cfg.heads) for _ in made])[[c.split(" ")[0] for c in ROW.split(", ")]]

    return t.mapInPandas(heads, ROW), blocks


def _began(blocks: int, cfg: Config) -> dict:
    return {"epoch": -1, "losses": [], "best": None, "best_epoch": -1, "idle": 0, "waited": 0, "rate": cfg.rate, "blocks": blocks, "config": asdict(cfg)}


def _after(state: dict, loss: float, cfg: Config) -> dict:
    """The state after one more epoch: whether it was the best, and the rate, which halves when none is for long."""
    better, epoch = state["best"] is None or loss < state["best"] - 1e-4, state["epoch"] + 1
    state = state | {"epoch": epoch, "losses": [*state["losses"], loss], "best": loss if better else state["best"], "best_epoch": epoch if better else state["best_epoch"], "idle": 0 if better else state["idle"] + 1, "waited": 0 if better else state["waited"] + 1}
    return state | {"rate": state["rate"] / 2, "waited": 0} if state["waited"] >= cfg.patience else state


def _alone(profiles: pa.Table, n: int, blocks: int, prints: bool, cfg: Config) -> list[float]:
    """The losses of ``fit`` in one task, for tables of few profiles (block, pid, ids, hops, weights, lo, hi)."""
    profiles = profiles.sort_by([("block", "ascending"), ("pid", "ascending")])
    held = {}
    for block, rows in _blocks(iter(profiles.combine_chunks().to_batches())):
        zero = lambda k: _lists(np.zeros((rows.num_rows, k)))  # noqa: B023, E731
        held[block] = rows.append_column("heads", _lists(_heads(rows["pid"].to_pylist(), cfg))).append_column("m", zero(cfg.heads * cfg.dim)).append_column("s", zero(cfg.heads)).combine_chunks()
    (a, m, s), state = _networks(n, cfg), _began(blocks, cfg)
    while state["epoch"] + 1 < cfg.epochs and state["idle"] < cfg.stop_after:
        epoch, loss, sums = state["epoch"] + 1, 0, np.zeros(a.shape, np.int64)
        for block, rows in held.items():
            lost, made, at, g = _epoch(block, rows, a, epoch, state["rate"], 1 / blocks, prints, cfg)
            loss += lost
            sums[at] += g
            held[block] = pa.table({c: made.get(c, rows[c]) for c in rows.column_names})
        a, m, s = adam(a, sums / UNIT, m, s, epoch + 1, state["rate"], cfg)
        state = _after(state, loss / UNIT / blocks, cfg)
    return state["losses"]


def _save(spark: SparkSession, a: np.ndarray, m: np.ndarray, s: np.ndarray, path: str) -> None:
    spark.createDataFrame(pa.table({"id": range(len(a)), "vec": a.tolist(), "m": m.tolist(), "s": s.tolist()})).write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = spark.read.parquet(path).orderBy("id").toPandas()  # a row for each network
    return tuple(np.stack(rows[c].to_numpy()).astype(np.float64) for c in ("vec", "m", "s"))


def _ids(spark: SparkSession, triplets: DataFrame) -> DataFrame:
    """(asn, id): a number for each network."""
    known = sorted(r.asn for r in triplets.select("asn").distinct().collect())
    if not known:
        raise ValueError("no triplets to train on")
    return spark.createDataFrame(pa.table({"asn": pa.array(known, pa.int64()), "id": pa.array(range(len(known)), pa.int32())}))


def fit(spark: SparkSession, triplets: DataFrame, cfg: Config, prints: DataFrame | None = None, at: str | None = None, stop_at: int | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """triplets (profile, asn, hop, weight), prints (pid, lo, hi) -> (asn, vec), (pid, heads) of the best epoch, and the losses.

    ``at``: a folder to go on in; ``stop_at``: return after so many epochs in all (to be continued).
    """
    at = (at or f"{shared_dir(spark)}/training-{uuid.uuid4().hex}").rstrip("/")
    ids = _ids(spark, triplets)
    n = ids.count()
    done = [n for n in commits.names(spark, f"{at}/epochs") if n.endswith(".json")]
    if done:
        state = json.loads(commits.read_text(spark, f"{at}/epochs/{done[-1]}"))
        a, m, s = _load(spark, f"{at}/networks-{state['epoch']}")
        rows = _profiles(spark, f"{at}/profiles-{state['epoch']}")
    else:
        rows, blocks = _start(triplets, prints, ids, cfg)
        (a, m, s), state = _networks(n, cfg), _began(blocks, cfg)
    shape = f"{ROW}, asn int, loss long, grad array<long>"
    last = min(cfg.epochs, stop_at if stop_at is not None else cfg.epochs)
    while state["epoch"] + 1 < last and state["idle"] < cfg.stop_after:
        epoch, rate, share = state["epoch"] + 1, state["rate"], 1 / state["blocks"]
        by_block = rows.repartition("block").sortWithinPartitions("block", "pid")
        by_block.mapInArrow(_job(a, epoch, rate, share, prints is not None, cfg), shape).write.mode("overwrite").parquet(f"{at}/profiles-{epoch}")
        made = spark.read.schema(shape).parquet(f"{at}/profiles-{epoch}").select("asn", "loss", "grad")
        sums = made.groupBy("asn").agg(F.sum("loss").alias("loss"), F.array(*(F.coalesce(F.sum(F.get("grad", F.lit(i))), F.lit(0)) for i in range(cfg.dim))).alias("g")).toArrow().combine_chunks()  # a row for each network, and one for the profiles
        asn, g = sums.column("asn").to_numpy(), np.zeros_like(a)
        loss = int(sums.column("loss").to_numpy()[asn == -1][0]) / UNIT / state["blocks"]
        g[asn[asn >= 0]] = sums.column("g").chunk(0).flatten().to_numpy().reshape(-1, cfg.dim)[asn >= 0] / UNIT
        rows = _profiles(spark, f"{at}/profiles-{epoch}")
        a, m, s = adam(a, g, m, s, epoch + 1, rate, cfg)
        _save(spark, a, m, s, f"{at}/networks-{epoch}")
        old, state = state, _after(state, loss, cfg)
        commits.write_text(spark, f"{at}/epochs/{epoch:06d}.json", json.dumps(state))
        for gone in {old["epoch"], old["best_epoch"]} - {state["epoch"], state["best_epoch"], -1}:
            commits.remove(spark, f"{at}/profiles-{gone}")
            commits.remove(spark, f"{at}/networks-{gone}")
    best = state["best_epoch"]
    networks = spark.read.parquet(f"{at}/networks-{best}").join(F.broadcast(ids), "id").select("asn", "vec")
    flat = _profiles(spark, f"{at}/profiles-{best}")
    profiles = flat.select("pid", F.transform(F.sequence(F.lit(0), F.lit(cfg.heads - 1)), lambda k: F.slice("heads", k * cfg.dim + 1, F.lit(cfg.dim))).alias("heads"))
    return networks, profiles, state["losses"]


def sweep(spark: SparkSession, triplets: DataFrame, configs: list[Config]) -> DataFrame:
    """A row for each configuration: geometry, dim, heads, seed, epochs, first and best loss. Where a table has more than ``FEW_PROFILES``
    they run one after another, each over all executors; a smaller one is handed to a task for each of them. Losses are the same."""
    ids, losses = _ids(spark, triplets), {}
    n, (dealt, _, profiles) = ids.count(), _dealt(triplets, None, ids, configs[0])
    if profiles <= FEW_PROFILES:
        blocks = [max(1, -(-profiles // c.block)) for c in configs]

        def run(rows: pa.Table) -> pa.Table:
            k = rows["run"][0].as_py()
            return pa.table({"run": pa.array([k], pa.int32()), "losses": pa.array([_alone(rows.drop_columns(["run"]), n, blocks[k], False, configs[k])], pa.list_(pa.float64()))})

        block = F.pmod(F.xxhash64("pid"), F.get(F.array(*map(F.lit, blocks)), F.col("run"))).cast("int")
        each = dealt.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1)))).withColumn("block", block)
        each = each.select("run", *(c for c in (x.split(" ")[0] for x in ROW.split(", ")) if c in dealt.columns)).repartition(4 * len(configs), "run")
        losses = {r.run: r.losses for r in each.groupBy("run").applyInArrow(run, "run int, losses array<double>").collect()}
    rows = []
    for k, c in enumerate(configs):
        found = losses[k] if k in losses else fit(spark, triplets, c)[2]
        rows.append((c.geometry, c.dim, c.heads, c.seed, len(found), found[0], min(found)))
    return spark.createDataFrame(rows, "geometry string, dim int, heads int, seed int, epochs int, first_loss double, best_loss double")


def summary(runs: DataFrame) -> DataFrame:
    """Series by geometry and seed, in order of the dimension."""
    s = F.sort_array(F.collect_list(F.struct("dim", "heads", F.round("best_loss", 6).alias("loss"))))
    return runs.groupBy("geometry", "seed").agg(F.count("*").alias("runs"), s.alias("series"))
