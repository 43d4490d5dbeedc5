"""Token counts by prefix dynamic programming.

For a sentencepiece BPE model the encoding of a prefix is the encoding of a shorter prefix and one more token, and that
token is the only vocabulary suffix which forms a valid pair with the last token before it. So one left-to-right pass
stores the exact token count at *every* prefix; truncation and budget questions are lookups in that table.

No vocabulary piece joins a word to a following space, and none has a line end, so the table of a text is built from the
tables of its units (a run of spaces with the word after it, or a line end). Unit tables are kept in a bounded memo. Pieces of
several spaces have equal scores, so no order and no unique last token; their counts repeat with the longest of them, which is
tabulated once and extended. The last space of a run goes with the word where a piece begins with both.

Defined cases: null text counts as empty (0 tokens); U+2581 in a text is the model's own sign for a space and counts as
one; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow, text_or_empty

#: Bounds of one worker's memos.
MEMO_UNITS, MEMO_PAIRS, MEMO_LENGTH = 1_200_000, 600_000, 48
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class _Counts(dict):
    def __init__(self, table):
        self.table = table

    def __missing__(self, unit):
        n = self.table.unit(unit)[-1]
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = n
        return n


class PrefixTable:
    """Exact token counts of one sentencepiece BPE model at every prefix of a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = self.model
        self.score = {
            m.id_to_piece(i): m.get_score(i)
            for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("a piece crosses a unit's border")
        self.lengths: dict[str, set[int]] | dict[str, list[int]] = {}  # of the pieces that end in these three characters
        for p in self.score:
            if len(p) > 2:
                self.lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) + [2, 1] for k, v in self.lengths.items()}
        self.blanks = [0, 1]  # counts of runs of spaces; from ``repeat`` spaces on with one more for each ``period``
        self.period = max((len(p) for p in self.score if not p.strip(SPACE)), default=1)
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.score):
            raise ValueError("a piece joins several spaces to a word")
        self.repeat = 3 * self.period
        self.blanks += [len(m.encode(SPACE * (n - 1))) for n in range(2, self.repeat + 2 * self.period + 1)]
        if any(self.blanks[n] != self.blanks[n - self.period] + 1 for n in range(self.repeat - self.period, len(self.blanks))):
            raise ValueError("runs of spaces don't repeat")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.counts = _Counts(self)

    def _merge(self, text: str) -> list[str]:
        """BPE by its definition, for pieces only: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _valid(self, a: str, b: str) -> bool:
        v = self.pairs.get((a, b))
        if v is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            v = self.pairs[a, b] = self._merge(a + b) == ([a, b] if a else [b])
        return v

    def spaces(self, n: int) -> int:
        """Tokens of a run of so many spaces."""
        if n < self.repeat:
            return self.blanks[n]
        more = (n - self.repeat) // self.period
        return self.blanks[n - more * self.period] + more

    def unit(self, unit: str) -> list[int]:
        """Token counts at the prefixes 0..len(unit) of one unit."""
        run = len(unit) - len(unit.lstrip(SPACE))
        if run < 2:
            return self._word(unit)[0]
        out = list(map(self.spaces, range(run + 1)))
        if run < len(unit):
            count, alone = self._word(unit[run - 1 :])
            out += [out[run] + c - 1 if own else out[run - 1] + c for c, own in zip(count[2:], alone[2:], strict=True)]
        return out

    def _word(self, unit: str) -> tuple[list[int], list[bool]]:
        """The same of a unit with one space at most, and whether its first character is a token of its own."""
        score, pairs, lengths, last, count, alone = self.score, self.pairs, self.lengths, [""], [0], [False]
        for i in range(1, len(unit) + 1):
            for n in lengths.get(unit[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                if n > i:
                    continue
                piece = unit[i - n : i]
                if n > 1 and piece not in score:
                    continue
                before = last[i - n]
                ok = pairs.get((before, piece))
                if ok is None:
                    ok = self._valid(before, piece)
                if ok:
                    last.append(piece)
                    count.append(count[i - n] + (1 if piece in score else len(piece.encode())))
                    alone.append(n == 1 if i == n else alone[i - n])
                    break
            else:
                raise AssertionError(f"no last token for {unit[:i]!r}")
        return count, alone

    def units(self, text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.units(text)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts at the prefixes 0..len(text), in code points."""
        if not text:
            return np.zeros(1, np.int64)
        out, at, base = np.zeros(len(text) + 2, np.int64), 0, 0  # of the text with the sign before it
        for u in self.units(text):
            c = self.unit(u)
            out[at + 1 : at + len(u) + 1] = base + np.array(c[1:])
            at += len(u)
            base += c[-1]
        out[1] = 0  # an empty prefix gets no sign
        return out[1:]

    def fit(self, text: str, limit: int) -> int:
        """The longest prefix, in code points, that has at most ``limit`` tokens."""
        units = self.units(text)
        sums = list(accumulate(map(self.counts.__getitem__, units), initial=0))
        if sums[-1] <= limit:
            return len(text)
        k = bisect_right(sums, limit) - 1  # sums never fall, so no later unit can fit
        inside = max(j for j, c in enumerate(self.unit(units[k])) if sums[k] + c <= limit)
        return max(0, sum(map(len, units[:k])) - 1 + inside)


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model_file: str) -> PrefixTable:
    """One table for each worker process and model."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PrefixTable(model_file)
    return _TABLES[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within the limit."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))

    def count(batches):
        t = prefix_table(model_file)
        for b in batches:
            ids, column = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 512):
                texts = column.slice(at, 512).to_pylist()
                n = [t.count(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 512),
                        pa.array([len(x.encode()) for x in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([c > limit for c in n], pa.bool_()),
                        pa.array([t.fit(x, limit) if c > limit else len(x) for x, c in zip(texts, n, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return arrow(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
