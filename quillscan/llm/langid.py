"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed
greedily into the longest phrases that occur in that training text (Ziv and Merhav's
cross parsing); the fewer phrases per symbol, the closer the text.  The language with
the fewest normalised phrases wins.

The automata's rows lie displaced in one table, each in the gaps of others, so memory
follows the training text, not the alphabet.  A missing transition starts a new phrase at the
root.  Many blocks of text are parsed at once, one symbol a step, by all languages; a
block is first parsed as if a phrase began with it and then again from the state that
the block before it ends in, until both parses start a phrase at the same place.  So
the result is the parse of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, raw, slices

#: The bounded training sample: rows per language, each of at most so many bytes of text; a row is used whole.
TRAIN_DOCS, TRAIN_DOC_BYTES = 24, 8_000
BLOCK = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case where that is one code point."""
    n = sys.maxunicode + 1
    alpha = np.zeros(n, bool)
    lower = np.arange(n, dtype=np.uint32)
    for c in range(n):
        ch = chr(c)
        if ch.isalpha():
            alpha[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return alpha, lower


def symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, runs of anything else as one 0; offsets; and which texts have a letter."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
    alpha, lower = _letters()
    solid = alpha[points]
    code = np.where(solid, lower[points], 0)
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first of a run of other characters stays
    inner = at[1:-1][at[1:-1] < len(points)]
    keep[inner] = solid[inner]
    count = np.concatenate(([0], np.cumsum(keep)))
    letters = np.concatenate(([0], np.cumsum(solid)))[at]
    return code[keep], count[at], np.diff(letters) > 0


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` of each row, and one table: entry ``base[s] + c`` holds ``s`` (upper half) and its target by ``c``.

    Row 0 (the root) gets no entries.  Rows are placed by trial, large ones first, in a
    table at most half full; rows of one entry then fill gaps.
    """
    size = 1 << int(2 * sum(map(len, rows)) + 2 * alphabet).bit_length()
    base = np.zeros(len(rows), np.int64)
    table = np.full(size, -1 << 32, np.int64)
    used = bytearray(size)
    used[: 2 * alphabet] = b"\x01" * (2 * alphabet)
    many = sorted((s for s in range(1, len(rows)) if len(rows[s]) > 1), key=lambda s: -len(rows[s]))
    trial = np.random.default_rng(0)
    tries = iter(())
    for s in many:
        row = rows[s]
        while True:
            at = next(tries, None)
            if at is None:
                tries = iter(trial.integers(alphabet, size - alphabet, 1 << 14).tolist())
            elif not any(used[at + c] for c in row):
                break
        base[s] = at
        for c, t in row.items():
            used[at + c] = 1
            table[at + c] = s << 32 | t
    one = [(s, *next(iter(rows[s].items()))) for s in range(1, len(rows)) if len(rows[s]) == 1]
    if one:
        state, symbol, target = np.asarray(one, np.int64).T
        gap = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)[: len(one)]
        base[state] = gap - symbol
        table[gap] = state << 32 | target
    return base, table


class Model:
    """Automata of all languages over a common alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        parts = []
        for lang in self.langs:
            buf = np.frombuffer("\n".join(samples[lang]).encode(), np.uint8)
            parts.append(symbols(buf, np.asarray([0, len(buf)]))[0])
        self.known = np.unique(np.concatenate([*parts, np.zeros(1, np.uint32)]))
        self.alphabet = len(self.known) + 1  # the last one stands for every other letter
        self.weight = np.asarray([np.log2(max(2, len(p))) for p in parts])
        self.root = np.zeros((len(self.langs), self.alphabet), np.int64)  # 0: a phrase of its own
        rows: list[dict[int, int]] = [{}]  # state 0 is every language's root
        for k, p in enumerate(parts):
            first, *rest = suffix_automaton(np.searchsorted(self.known, p))
            shift = len(rows) - 1
            for c, t in first.items():
                self.root[k, c] = t + shift
            rows += [{c: t + shift for c, t in row.items()} for row in rest]
        self.base, self.table = displaced(rows, self.alphabet)

    def _step(self, lang: int, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        got = self.table.take(self.base.take(state) + sym)
        begins = (got >> 32) != state
        begins |= state == 0
        return np.where(begins, self.root[lang].take(sym), got & 0xFFFFFFFF), begins

    def phrases(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by each language (columns), symbols of each text, and which have a letter."""
        code, at, letters = symbols(buf, offs)
        place = np.searchsorted(self.known, code)
        place[place == len(self.known)] = 0
        sym = np.where(self.known[place] == code, place, self.alphabet - 1).astype(np.int32)
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[:-1][text] + nth * BLOCK
        length = np.minimum(BLOCK, at[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        lane = np.empty_like(order)  # where each block stands among those sorted by length
        lane[order] = np.arange(len(order))
        active = np.searchsorted(-length[order], -np.arange(BLOCK), "left")  # blocks longer than each step
        grid = np.zeros((BLOCK, len(order)), np.int32)  # the symbols, a step a row
        padded = np.concatenate((sym, np.zeros(BLOCK, np.int32)))
        for step in range(BLOCK):
            grid[step, : active[step]] = padded[begin[order[: active[step]]] + step]
        out = np.zeros((len(size), len(self.langs)))
        for k in range(len(self.langs)):  # a language at a time bounds memory by the slice
            starts = np.zeros(grid.shape, bool)  # where phrases begin
            state = np.zeros(len(order), np.int64)
            for step in range(BLOCK):
                m = int(active[step])
                if not m:
                    break
                state[:m], starts[step, :m] = self._step(k, state[:m], grid[step, :m])
            end = state[lane]
            given = np.zeros(len(order), np.int64)  # the states that blocks were parsed from
            due = np.flatnonzero(nth > 0)
            while len(due := due[end[due - 1] != given[due]]):  # whose predecessor ends in another state than assumed
                given[due] = end[due - 1]
                before = end[due]
                end[due] = self._again(k, grid, starts, lane[due], length[due], given[due], before)
                due = due[end[due] != before] + 1
                due = due[due < len(nth)]
                due = due[nth[due] > 0]
            out[:, k] = np.bincount(text, starts.sum(axis=0)[lane], len(size))
        return out, size, letters

    def _again(self, lang: int, grid: np.ndarray, starts: np.ndarray, lane: np.ndarray, length: np.ndarray, state: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Parse blocks anew from other states, until the parse in ``starts`` begins a phrase at the same place; their end states."""
        end = end.copy()
        who = np.arange(len(lane))
        for step in range(BLOCK):
            over = length == step
            if over.any():
                end[who[over]] = state[over]
                who, lane, length, state = who[~over], lane[~over], length[~over], state[~over]
            if not len(who):
                return end
            state, new = self._step(lang, state, grid[step, lane])
            apart = ~(new & starts[step, lane])
            starts[step, lane] = new
            if not apart.all():
                who, lane, length, state = who[apart], lane[apart], length[apart], state[apart]
        end[who] = state
        return end

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offs) - 1
        if not self.langs or not len(buf):
            return [UNKNOWN] * n, np.zeros(n)
        count, size, letters = self.phrases(buf, offs)
        rate = count * self.weight / np.maximum(size, 1)[:, None]
        best = np.argmin(rate, axis=1)
        ordered = np.sort(rate, axis=1)
        score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(n)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(score, 0, 1), 0.0)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded hash sample of the labelled rows that are not held out.

    Per language about ``TRAIN_DOCS`` rows are used, at most twice as many, equal rows once, whole, out of those of at most
    ``TRAIN_DOC_BYTES`` bytes; a language that has only longer texts trains on its
    shortest one.  So what comes to the driver is bounded per language.  Rows with a
    null id, text or label do not train; ids, sources and labels are never seen by the
    model but as the class.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.filter(~held_out(F.col("id"))).withColumns({"size": F.octet_length("text"), "h": F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1_000_000_007))})
    least = F.min(F.when(F.col("size") > TRAIN_DOC_BYTES, F.struct("size", "h"))).alias("least")
    fits = F.when(F.col("size") <= TRAIN_DOC_BYTES, F.col("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(fits).alias("n"), F.min(fits).alias("first"), least).collect()  # a row per language
    if not sizes:
        return Model({})
    share = [(r.lang, max(r.first, int(1_000_000_007 * min(1.0, TRAIN_DOCS / r.n))), TRAIN_DOC_BYTES, None) if r.n else (r.lang, 1_000_000_007, r.least["size"], r.least["h"]) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(share, "lang string, below long, most long, only long")
    picked = rows.join(F.broadcast(bounds), "lang").filter("h <= below AND size <= most AND coalesce(h = only, true)").select("lang", "h", "text")
    picked = picked.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= 2 * TRAIN_DOCS)
    samples: dict[str, list[tuple]] = {}
    for r in picked.collect():
        samples.setdefault(r.lang, []).append((r.h, r.text))
    return Model({k: [t for _, t in sorted(v)] for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1 (the lead over the runner-up).

    Every text is parsed whole.  Null texts and texts without a letter are ``und`` with
    score 0.  A name in ``pred_col`` or ``score_col`` that ``docs`` has already is an error; all
    other columns pass through, whatever they are called.  Ties go to the first language by name.
    """
    if taken := {pred_col, score_col} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            lang, score = held.value.predict(*raw(column(part, text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, pred_col, score_col])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))
