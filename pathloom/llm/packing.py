"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of ``capacity`` tokens; whole pieces are sequences of their own. The rest is
dealt at random into blocks of a bounded number of pieces. Each block has some islands, each island a small population of
packings. A child takes whole well-filled bins from one parent, drops the bins of the other that hold a repeated piece, and
places what those had held by best fit. After each epoch every island sends its elite to the next island of its block; in
the last epoch the best packing of the block stands. Bins that are still poorly filled are opened and packed once more
across blocks. Only (row number, length) pairs take part, and no task gets more than a block.

Token ids are those of the tokenizers library. Texts are split at spaces and line ends (which yield no token, join no token
and compose with no neighbour) and each distinct chunk of a batch is looked up once, in Arrow. Chunks of small letters below
U+0240, or of these and marks after them, go to the library's BPE model at once, as its normaliser and splitter would not
change them; any other chunk takes the library's whole way. Texts of such characters, without a special token's sign, are
put in lower case first. Ids of chunks are kept in a bounded memo.

Defined cases: null text is empty and yields the end id alone; repeated rows are each packed; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, materialize, release, text_or_empty

MEMO_CHUNKS, MEMO_LENGTH = 150_000, 48
#: See _unusual; marks that may follow a word.
UNUSUAL, MARKS = re.compile("[\u0130\u0240-\U0010ffff]"), "!#$%&()*+,-./:;<=>?@[]^_{|}~"


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.memo: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes the other bytes from U+0100 on
        other = (b for b in range(256) if b not in set(printable))
        self.letters = str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(other)})

    def _plain(self, word: str) -> bytes:
        """Of lower-case letters only."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(word))

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        out, hard = [memo.get(c) for c in chunks], []
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            c = chunks[i]
            core = c if c.isalpha() else c.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or not UNUSUAL.search(core)) and core.lower() == core:
                ids = memo.get(core)
                if ids is None:
                    ids = self._plain(core)
                    if len(core) <= MEMO_LENGTH:
                        memo[core] = ids
                if len(core) < len(c):
                    mark = c[len(core) :]
                    ids += memo.get(mark) or memo.setdefault(mark, self._whole([mark])[0])
                out[i] = ids
            else:
                hard.append(i)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            for i, ids in zip(part, self._whole([chunks[i] for i in part]), strict=True):
                out[i] = ids
                if len(chunks[i]) <= MEMO_LENGTH:
                    memo[chunks[i]] = ids
        return out

    def of(self, texts: pa.Array) -> list[memoryview]:
        lower = pc.and_not(pc.true_unless_null(texts), pc.or_(pc.match_substring(texts, "<|"), _unusual(texts)))
        spaced = pc.replace_substring(pc.if_else(lower, pc.utf8_lower(texts), texts), "\n", " ")
        words = pc.split_pattern(spaced, " ")
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self.chunks(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [memoryview(b"")] * len(texts)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][words.offsets.to_numpy() - words.offsets[0].as_py()]
        data = memoryview(ids.buffers()[2] or b"")
        return [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _unusual(texts: pa.Array) -> pa.Array:
    """Whether a text has a character from U+0240 on, or U+0130, whose lower case or composition may need the whole way."""
    start, stop = texts.offset, texts.offset + len(texts) + 1
    ends = np.frombuffer(texts.buffers()[1], np.int32)[start:stop].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    odd = data >= 0xC9
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    places = np.flatnonzero(odd)
    return pa.array(np.searchsorted(places, ends[1:]) > np.searchsorted(places, ends[:-1]))


_IDS: dict[str, Ids] = {}


def _rows_within(column: pa.Array, at: int, rows: int = 1024, size: int = 4_000_000) -> int:
    """So many rows from ``at`` on hold at most ``size`` bytes; one at least."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + at : column.offset + min(len(column), at + rows) + 1]
    return max(1, int(np.searchsorted(ends, int(ends[0]) + size, side="right")) - 1)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        if tokenizer_file not in _IDS:
            _IDS[tokenizer_file] = Ids(tokenizer_file)
        ids, end = _IDS[tokenizer_file], end_id.to_bytes(4, "little")
        for b in batches:
            keys, column, at = b.column(0).to_pylist(), b.column(1), 0
            while at < b.num_rows:
                n = _rows_within(column, at)
                out: list[list] = [[] for _ in names]
                for key, tokens in zip(keys[at : at + n], ids.of(column.slice(at, n)), strict=True):
                    total = len(tokens) // 4 + 1
                    for k, s in enumerate(range(0, total, capacity)):
                        crc = zlib.crc32(tokens[4 * s : 4 * (s + capacity)])
                        last = s + capacity >= total
                        for c, v in zip(out, (key, k, s, total - s if last else capacity, zlib.crc32(end, crc) if last else crc), strict=True):
                            c.append(v)
                at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)
        ids.memo.clear()
        release()

    return arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the grouping genetic algorithm, over lists of lengths ---


def best_fit(order: list[int], size: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Place items in this order, each into the open bin with the least room that it fits; bins grow in place."""
    room: dict[int, list[int]] = {}
    free = 0  # bit r: a bin with room r exists
    for k, b in enumerate(bins):
        r = capacity - sum(map(size.__getitem__, b))
        room.setdefault(r, []).append(k)
        free |= 1 << r
    for item in order:
        s = size[item]
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            bins[k].append(item)
            r -= s
        else:
            k, r = len(bins), capacity - s
            bins.append([item])
        room.setdefault(r, []).append(k)
        free |= 1 << r
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven the fill, the better."""
    return len(bins), -sum((sum(map(size.__getitem__, b)) / capacity) ** 2 for b in bins)


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``b`` enter ``a``; bins of ``a`` that hold a repeated item go, and what they held is re-placed."""
    filled = sorted(b, key=lambda x: -sum(map(size.__getitem__, x)))
    best = filled[: max(1, len(filled) // 2)]
    taken = rng.sample(best, rng.randint(1, len(best)))
    inside = {i for x in taken for i in x}
    child, loose = [list(x) for x in taken], []
    for x in a:
        if inside.isdisjoint(x):
            child.append(list(x))
        else:
            loose += [i for i in x if i not in inside]
    poor = min(range(len(child)), key=lambda k: sum(map(size.__getitem__, child[k])))  # the poorest bin is opened too
    loose += child.pop(poor)
    return best_fit(sorted(loose, key=lambda i: (-size[i], i)), size, capacity, child)


def evolve(size: list[int], capacity: int, population: list[list[list[int]]], rng: random.Random, members: int, rounds: int) -> list[list[list[int]]]:
    """The population after ``rounds``, best first. It ends early at the lower bound."""
    bound = ceil(sum(size) / capacity)
    everything = sorted(range(len(size)), key=lambda i: (-size[i], i))
    while len(population) < members:
        shake = 0 if not population else 0.05 * len(population)
        population.append(best_fit(sorted(everything, key=lambda i: (-size[i] * (1 - shake * rng.random()), i)), size, capacity, []))
    ranked = sorted(((fitness(p, size, capacity), p) for p in population), key=lambda x: x[0])[:members]
    for _ in range(rounds):
        if ranked[0][0][0] <= bound:
            break
        i, j = sorted(rng.sample(range(len(ranked)), 2)) if len(ranked) > 1 else (0, 0)
        child = cross(ranked[i][1], ranked[j][1], size, capacity, rng)
        f = fitness(child, size, capacity)
        if f < ranked[-1][0] and f not in [x[0] for x in ranked]:
            ranked[-1] = (f, child)
            ranked.sort(key=lambda x: x[0])
    return [p for _, p in ranked]


def _island(key, rows: pd.DataFrame, capacity: int, members: int, rounds: int) -> pd.DataFrame:
    """rows: one for each piece and known packing (origin, bin; -1: none yet). Gives the island's elite."""
    block, island = int(key[0]), int(key[1])
    first = rows.drop_duplicates("uid").sort_values("uid")
    uids, size = first["uid"].tolist(), first["length"].tolist()
    place = {u: i for i, u in enumerate(uids)}
    population = []
    for _, r in rows[rows["bin"] >= 0].sort_values(["origin", "uid"]).groupby("origin"):
        bins: dict[int, list[int]] = {}
        for u, b in zip(r["uid"], r["bin"], strict=True):
            bins.setdefault(b, []).append(place[u])
        population.append(list(bins.values()))
    rng = random.Random(f"{block} {island} {len(population)} {len(uids)}")
    best = evolve(size, capacity, population, rng, members, rounds)[0]
    n = fitness(best, size, capacity)
    fill = [sum(map(size.__getitem__, b)) for b in best]
    out = [(uids[i], size[i], k, fill[k]) for k, b in enumerate(best) for i in b]
    frame = pd.DataFrame(out, columns=["uid", "length", "bin", "fill"])
    return frame.assign(block=block, island=island, n_bins=n[0], uneven=n[1])[["block", "island", "uid", "length", "bin", "fill", "n_bins", "uneven"]]


ELITE = "block long, island int, uid long, length long, bin int, fill long, n_bins int, uneven double"


def _pack_blocks(items: DataFrame, n_items: int, capacity: int, block_items: int, islands: int, epochs: int, members: int, rounds: int, salt: int) -> DataFrame:
    """items (uid, length) -> (block, uid, length, bin, fill)."""
    blocks = max(1, ceil(n_items / block_items))
    base = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(blocks)).alias("block"))
    island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = base.select("*", island).select("block", "island", "uid", "length", F.lit(-1).alias("origin"), F.lit(-1).alias("bin"))
    for _ in range(epochs):
        elite = materialize(state.groupBy("block", "island").applyInPandas(lambda key, rows: _island(key, rows, capacity, members, rounds), ELITE), "pack-elite")
        own = elite.select("block", "island", "uid", "length", F.col("island").alias("origin"), "bin")
        sent = elite.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), "uid", "length", F.col("island").alias("origin"), "bin")
        state = own.unionByName(sent) if islands > 1 else own
    best = elite.groupBy("block", "island").agg(F.first("n_bins").alias("n_bins"), F.first("uneven").alias("uneven")).groupBy("block").agg(F.min(F.struct("n_bins", "uneven", "island")).alias("b"))
    best = best.select("block", F.col("b.island").alias("island"))
    return elite.join(best, ["block", "island"]).select("block", "uid", "length", "bin", "fill")


def pack(cut: DataFrame, capacity: int = 2048, block_items: int = 2000, islands: int = 2, epochs: int = 2, members: int = 4, rounds: int = 10, refill: float = 0.985) -> DataFrame:
    """Adds sequence_id and offset to pieces. Any columns with a ``length`` of at most ``capacity`` may be packed."""
    made = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    rows = materialize(cut.select(*made).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    whole, rest = rows.where(F.col("length") >= capacity), rows.where(F.col("length") < capacity).select("uid", "length")
    full = whole.select(*made, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    how = {"capacity": capacity, "block_items": block_items, "islands": islands, "members": members, "rounds": rounds}
    first = materialize(_pack_blocks(rest, rest.count(), epochs=epochs, salt=1, **how), "pack-first")
    good = first.where(F.col("fill") >= refill * capacity).select("uid", "length", "block", "bin", F.lit(0).alias("level"))
    poor = first.where(F.col("fill") < refill * capacity).select("uid", "length")
    again = _pack_blocks(poor, poor.count(), epochs=1, salt=2, **how).select("uid", "length", "block", "bin", F.lit(1).alias("level"))
    placed = good.unionByName(again).withColumn("sequence_id", (F.col("block") * 2 + F.col("level")) * F.lit(1 << 22) + F.col("bin"))
    in_bin = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("p"))  # a bin has at most ``capacity`` pieces
    offsets = in_bin.select("sequence_id", F.posexplode("p").alias("k", "x"), "p").select(
        F.col("x.uid").alias("uid"), "sequence_id", F.aggregate(F.slice("p", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset")
    )
    return rows.join(offsets, "uid").select(*made, "sequence_id", "offset").unionByName(full)
