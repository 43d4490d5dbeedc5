"""Language identification by cross-parsing entropy.

Each language's labelled text gives a suffix automaton. A document is parsed greedily into the longest phrases that occur
in that text; the fewer phrases a character needs, the better the language explains it. Phrases are normalised to bits a
character, phrases x log2(length of the language's text) / characters, and the language with the least bits wins; equal
languages are decided by name.

Each letter of the samples has a class of its own. An automaton's transitions stand in one array by row displacement: those of
a state begin at its own offset, fill the gaps that others leave, and carry their owner, so a step is two look-ups, whatever
the alphabet; two megabytes hold a language. Automata are built by grouped tasks, one for each language, and written as a
table; ``GROUP_LANGS`` of them at a time are broadcast and parse all documents, which carry their best two languages on to the
next group. So neither the driver nor a worker holds more than a group, and no label is left out.

Many places of the texts step together: texts are cut into blocks of ``BLOCK`` characters, which first all begin a phrase.
Then each block is entered with the state that its predecessor ended in, until a phrase ends where one of the first pass
does; from there on both are equal. The result is the greedy parse of the whole text, not one for each block.

The training text is a bounded sample of every label: ``train_chars`` characters a language, in pieces of ``train_chars /
train_docs`` characters that a hash of id and place chooses from all its labelled text. All else covers all rows.

Defined cases: null or letterless text is ``und`` with score 0; without any labelled document everything is ``und``;
with one label alone the score is 1; languages with equal bits: the first by name; repeated rows are each predicted; extra
columns, whatever their names, are ignored or, by ``label``, kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow, fresh, id_remainder, in_share, materialize, release, temporary

BLOCK = 512
#: Languages whose tables (about 2 MB each) are broadcast at once.
GROUP_LANGS = 16
#: Up to so many labels (one row each) are broadcast; beyond, they are joined by shuffle.
FEW_LANGS = 20_000
#: Texts parsed at once hold about so many characters; a longer text is parsed in portions of so many.
PARSE_CHARS = 2_000_000
#: Gaps that a row of several steps is tried at before it goes to the end.
TRIES = 64
TABLES = "lang string, states int, starts binary, offsets binary, steps binary, bits double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(seen: str) -> np.ndarray:
    """A class for each code point: 0 for what is no letter, 1 for letters that ``seen`` lacks, and one from 2 on for each other."""
    table = np.zeros(0x110000, np.int32)
    letters = [i for i in range(len(table)) if chr(i).isalpha()]
    table[letters] = 1
    for k, c in enumerate(sorted({ord(c) for c in seen.lower() if c.isalpha()}), 2):
        table[c] = k
    for c in letters:  # a capital letter goes with its small one
        low = chr(c).lower()
        if low != chr(c):
            table[c] = table[ord(low[0])]
    return table


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of a text's characters; runs of what is no letter count as one."""
    c = table[code_points(text)]
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    return c[keep]


def transitions(seq: list[int]) -> list[dict[int, int]]:
    """The automaton of all factors of ``seq``: for each state the next state by symbol (state 0 starts)."""
    most = max(2, 2 * len(seq))
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    assert len(step) <= most + 1
    return step


class Automaton:
    """Greedy parsing over displaced rows.

    ``steps[offsets[state] + class]`` holds the row's owner (high half) and the next state. A missing step begins a phrase
    afresh with ``starts[class]``; a symbol that the sample lacks is a phrase of its own, the added state without steps.
    """

    def __init__(self, states: int, starts: np.ndarray, offsets: np.ndarray, steps: np.ndarray, bits: float):
        self.states, self.starts, self.offsets, self.steps, self.bits = states, starts, offsets, steps, bits

    @classmethod
    def of(cls, seq: list[int], size: int) -> Automaton:
        step = transitions(seq)
        n = len(step)
        starts = np.full(size, n, np.int32)
        starts[list(step[0])] = list(step[0].values())
        offsets = np.zeros(n + 1, np.int32)
        places: dict[int, tuple[int, int]] = {}
        near, end = size, size  # gaps are sought from ``near`` on; from ``end`` on all is free
        for s in sorted((s for s in range(n) if len(step[s]) > 1), key=lambda s: -len(step[s])):  # widest rows first
            symbols = sorted(step[s])
            for at in range(near, near + TRIES):
                if not any(at + c in places for c in symbols):
                    break
            else:
                near = min(near + TRIES // 4, end)
                at = end
            offsets[s] = at
            for c in symbols:
                places[at + c] = (s, step[s][c])
            end = max(end, at + symbols[-1] + 1)
        gap = size
        for s in range(n):  # rows of one step fill the gaps that are left
            for c, to in step[s].items() if len(step[s]) == 1 else ():
                while gap in places:
                    gap += 1
                offsets[s] = gap - c
                places[gap] = (s, to)
        steps = np.full(max(places, default=0) + size + 1, -1, np.int64)
        at = np.fromiter(places, np.int64, len(places))
        owner_to = np.array(list(places.values()), np.int64).reshape(-1, 2)
        steps[at] = (owner_to[:, 0] << 32) | owner_to[:, 1]
        return cls(n, starts, offsets, steps, float(np.log2(len(seq) + 1)))

    def row(self, lang: str) -> tuple:
        return lang, self.states, self.starts.tobytes(), self.offsets.tobytes(), self.steps.tobytes(), self.bits

    @classmethod
    def from_row(cls, r) -> Automaton:
        return cls(r.states, *(np.frombuffer(x, t) for x, t in ((r.starts, np.int32), (r.offsets, np.int32), (r.steps, np.int64))), r.bits)


class Model:
    """Some languages' automata over one alphabet, as one: states and steps of a language follow those of the one before."""

    def __init__(self, table: np.ndarray, automata: dict[str, Automaton]):
        self.table, self.langs = table, sorted(automata)
        every = [automata[lang] for lang in self.langs]
        self.bits, self.size = np.array([a.bits for a in every]), int(table.max()) + 1
        first = np.concatenate([[0], np.cumsum([a.states + 1 for a in every])]).astype(np.int64)
        place = np.concatenate([[0], np.cumsum([len(a.steps) for a in every])]).astype(np.int64)
        self.first = first[:-1].astype(np.int32)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.starts = join([a.starts + f for a, f in zip(every, first, strict=False)], np.int32)
        self.offsets = join([a.offsets + p for a, p in zip(every, place, strict=False)], np.int32)
        self.steps = join([np.where(a.steps < 0, a.steps, a.steps + ((f << 32) | f)) for a, f in zip(every, first, strict=False)], np.int64)

    @classmethod
    def of(cls, samples: dict[str, list[str]], train_chars: int) -> Model:
        table = alphabet("".join(set("".join(t for texts in samples.values() for t in texts))))
        return cls(table, {lang: automaton(texts, table, train_chars) for lang, texts in samples.items()})

    def step(self, state: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a new phrase began; ``start``: where each one's language begins in ``starts``."""
        v = self.steps.take(self.offsets.take(state) + c)
        afresh = (v >> 32) != state
        after = v.astype(np.int32)
        np.copyto(after, self.starts.take(start + c), where=afresh)
        return after, afresh

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (texts x languages) and characters of each text."""
        codes = [classes(t, self.table) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        at = 0
        while at < len(texts):
            if sizes[at] > PARSE_CHARS:
                state = None
                for i in range(0, int(sizes[at]), PARSE_CHARS):
                    got, state = self._parse([codes[at][i : i + PARSE_CHARS]], state)
                    counts[at] += got[0]
                at += 1
                continue
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + sizes[end] <= PARSE_CHARS) and sizes[end] <= PARSE_CHARS:
                chars += sizes[end]
                end += 1
            counts[at:end] = self._parse(codes[at:end], None)[0]
            at = end
        return counts, sizes

    def _parse(self, codes: list[np.ndarray], entered: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each text; ``entered``: for each language the state in which the (only) text goes on. Also the last states."""
        langs, sizes = len(self.langs), np.array([len(c) for c in codes], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(codes)), blocks)
        if not len(owner) or not langs:
            return np.zeros((len(codes), langs), np.int64), self.first.copy()
        everything = np.concatenate(codes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        long = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
        order = np.argsort(-long, kind="stable")
        lane_of = np.empty(len(order), np.int64)
        lane_of[order] = np.arange(len(order))
        after = np.where(np.append(within[1:] > 0, False), np.append(lane_of[1:], 0), -1)[order]  # the lane of the block that follows
        last = int(lane_of[-1])
        at, long, owner, first = (begin[owner] + within * BLOCK)[order], long[order], owner[order], within[order] == 0
        active = np.searchsorted(-long, -np.arange(BLOCK), side="left")  # blocks with more than i characters
        most, lanes = int(long[0]), len(at)
        start = (np.arange(langs) * self.size)[:, None]
        broken = np.zeros((most, langs, lanes), np.bool_)
        state = np.repeat(self.first[:, None], lanes, axis=1)
        for i in range(most):
            n = active[i]
            state[:, :n], broken[i, :, :n] = self.step(state[:, :n], everything[at[:n] + i], start)
        broken[0] = True
        # from here on a lane is a language's: numbered language by language
        broken, state, marks = broken.reshape(most, -1), state.ravel(), np.repeat(np.arange(langs), lanes)
        after = np.concatenate([np.where(after >= 0, after + k * lanes, -1) for k in range(langs)])
        at, long, start = np.tile(at, langs), np.tile(long, langs), marks * self.size
        wrong = np.flatnonzero(after >= 0)  # lanes whose followers were entered in another state than they must be
        lane, now = after[wrong], state[wrong]
        if entered is not None:
            lane, now = np.append(lane, np.flatnonzero(np.tile(first, langs))), np.append(now, entered)
        while len(lane):
            left, i, ended = np.arange(len(lane)), 0, []
            while len(left):
                done = long[lane[left]] <= i
                if done.any():
                    ended.append(left[done])
                    left = left[~done]
                    continue
                some = lane[left]
                now[left], new = self.step(now[left], everything[at[some] + i], start[some])
                same = new & broken[i, some]
                broken[i, some] = new
                left = left[~same]
                i += 1
            through = np.concatenate([np.zeros(0, np.int64), *ended])
            differ = through[state[lane[through]] != now[through]]
            some = lane[differ]
            state[some] = now[differ]
            go_on = after[some] >= 0
            lane, now = after[some[go_on]], now[differ[go_on]]
        counts = np.bincount(marks * len(codes) + np.tile(owner, langs), broken.sum(axis=0), langs * len(codes)).astype(np.int64)
        return counts.reshape(langs, len(codes)).T, state[np.arange(langs) * lanes + last]

    def bits_per_character(self, texts: list[str]) -> np.ndarray:
        counts, sizes = self.phrases(texts)
        return counts * self.bits / np.maximum(sizes, 1)[:, None]


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def score(best: float, second: float | None) -> float:
    """1 - bits of the best language / bits of the second."""
    return 1.0 if second is None else float(np.clip(1 - best / second if second else 0, 0, 1))


def automaton(texts: list[str], table: np.ndarray, train_chars: int) -> Automaton:
    pieces = [classes(t, table) for t in texts]
    seq = np.concatenate([p for p in pieces if len(p)] or [np.zeros(1, np.int32)])[:train_chars]
    return Automaton.of(seq.tolist(), int(table.max()) + 1)


class Languages:
    """What ``fit`` gives: the alphabet's letters, the labels and the table of automata, of which groups are read as wanted."""

    def __init__(self, letters: str, langs: list[str], tables: DataFrame | None):
        self.letters, self.langs, self.tables = letters, langs, tables

    def groups(self):
        table = alphabet(self.letters)
        for at in range(0, len(self.langs), GROUP_LANGS):
            some = self.langs[at : at + GROUP_LANGS]
            yield Model(table, {r.lang: Automaton.from_row(r) for r in self.tables.where(F.col("lang").isin(some)).toLocalIterator()})


def samples(docs: DataFrame, train_docs: int, train_chars: int) -> DataFrame:
    """(lang, before, text): pieces of each label's text in order of their hashes, up to ``train_chars`` characters a label."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False))
    )
    piece = max(1, train_chars // train_docs)
    rows = rows.withColumn("n", F.ceil(F.length("text") / piece).cast("int")).where("n > 0")
    totals = rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.sum(F.col("n").cast("long")).alias("pieces"))
    totals = materialize(totals.withColumn("share", 1.5 * train_chars / F.col("chars") + 20 / F.col("pieces")).select("lang", "share"), "language-shares")
    if totals.limit(FEW_LANGS + 1).count() <= FEW_LANGS:
        totals = F.broadcast(totals)
    before = Window.partitionBy("lang").orderBy("h", "doc_id", "i", "text").rowsBetween(Window.unboundedPreceding, -1)
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: in_share(F.xxhash64("doc_id", i), F.col("share")))
    return (
        rows.join(totals, "lang")
        .select("lang", "doc_id", "text", F.explode(places).alias("i"))
        .select("lang", "doc_id", "i", F.xxhash64("doc_id", "i").alias("h"), F.substring("text", F.col("i") * piece + 1, F.lit(piece)).alias("text"))
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
        .where(F.col("before") < train_chars)
        .select("lang", "before", "text")
    )


def fit(docs: DataFrame, train_docs: int = 200, train_chars: int = 40_000) -> Languages:
    """Learn from labelled rows outside the held-out fifth (crc32 of the id modulo 5 is 0), within the bounds above."""
    with temporary(docs.sparkSession):
        return _fit(docs, train_docs, train_chars)


def _fit(docs: DataFrame, train_docs: int, train_chars: int) -> Languages:
    chosen = materialize(samples(docs, train_docs, train_chars), "language-samples")
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not langs:
        return Languages("", [], None)
    # distinct characters: the code points of Unicode at most
    letters = "".join(sorted(r.c for r in chosen.select(F.explode(F.split("text", "")).alias("c")).distinct().collect()))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        made = automaton(rows.sort_values("before")["text"].tolist(), alphabet(letters), train_chars)
        release()
        return pd.DataFrame([made.row(key[0])], columns=[x.split()[0] for x in TABLES.split(", ")])

    return Languages(letters, langs, materialize(chosen.groupBy("lang").applyInPandas(build, TABLES), "language-tables", keep=True))


def _parsed(rows: DataFrame, model: Languages, text: int) -> DataFrame:
    """Positional rows (c0.., the text at place ``text``) with (lang, bits, second) in three further columns."""
    spark, n = rows.sparkSession, len(rows.columns)
    rows = rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("second"))
    for group in model.groups():
        shared = spark.sparkContext.broadcast(group)
        del group

        def parse(batches, shared=shared):
            m = shared.value
            for b in batches:
                texts = b.column(text).to_pylist()
                was = [c.to_pylist() for c in b.columns[n:]]
                real = [i for i, t in enumerate(texts) if lettered(t)]
                for i, bits in zip(real, m.bits_per_character([texts[i] for i in real]) if real else (), strict=True):
                    for lang, x in zip(m.langs, bits.tolist(), strict=True):
                        if was[0][i] is None:
                            was[0][i], was[1][i] = lang, x
                        elif x < was[1][i]:
                            was[0][i], was[1][i], was[2][i] = lang, x, was[1][i]
                        elif was[2][i] is None or x < was[2][i]:
                            was[2][i] = x
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(was[0], pa.string()), pa.array(was[1], pa.float64()), pa.array(was[2], pa.float64())], names=b.schema.names)
            release()

        rows = arrow(rows, parse, rows.schema)
    release()
    return rows


def _judged() -> tuple:
    known = F.col("lang").isNotNull()
    ratio = F.when(F.col("second").isNull(), 1.0).when(F.col("second") == 0, 0.0).otherwise(1 - F.col("bits") / F.col("second"))
    return F.coalesce("lang", F.lit("und")), F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))).otherwise(0.0)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 - bits of the best language / bits of the second)."""
    held = F.coalesce(id_remainder(docs["doc_id"], 5) == 0, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("c0"), held.alias("c1"), docs["text"].cast("string").alias("c2"))
    lang, score = _judged()
    return _parsed(rows, model, 2).select(F.col("c0").alias("doc_id"), F.col("c1").alias("held_out"), lang.alias("lang_pred"), score.alias("score"))


def label(docs: DataFrame, model: Languages) -> tuple[DataFrame, str]:
    """Docs with one more column, the predicted language, and that column's name, which no other column has."""
    names, new = docs.columns, fresh(docs, "lang_pred")
    rows = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    if dict(docs.dtypes)["text"] != "string":
        raise TypeError("text must be a string")
    lang, _ = _judged()
    return _parsed(rows, model, names.index("text")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), lang.alias(new)), new
