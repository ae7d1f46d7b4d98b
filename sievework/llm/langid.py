"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled sample text is built. A document is parsed greedily into
the longest phrases that occur in a language's sample: from the automaton's root as far as transitions
go, then again from the root. Phrases cost log2 of the sample's length each; the language whose parse
costs the fewest bits per character wins, ties go to the first name. The score is the winner's share when
each language weighs 2 ** -(bits per character).

Sample: of each language training documents of ``SAMPLE_CHARS`` characters in all, ``SAMPLE_DOCS`` at most. Those of
``PREFERRED`` length come first, by id hash; then shorter ones, the longest first; then longer ones, the
shortest first. Only where the first document is longer than ``SAMPLE_CHARS`` is the sample its start: that is the
bound on labelled text. So every language with a labelled letter is learned, whatever the lengths of its texts.

An automaton's transitions on the language's ``COLUMNS`` most frequent characters are a dense table, those on
its other characters a sorted list of (state, character). Tables are broadcast with the task; the size of
each is bounded by the sample and ``COLUMNS`` (some 12 MB), and all of them by ``TABLE_BYTES``: beyond that the
languages are dealt into groups that the documents pass one after the other.

Texts are lower-cased; every run of characters that are no letters is one space. A text is parsed in
blocks of ``BLOCK`` characters side by side, each from the root. Then each block is entered again with the state
in which the one before ends, until a phrase starts at the same place as before: the phrases are those of the
whole text in one go, and long texts are as parallel as short ones.

Edge cases: null text and text without a letter give ``und`` with score 0; with no labelled training text
every document gives ``und`` and 0; characters outside a sample are a phrase each; null labels
are ignored; equal rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import held_out, map_batches, slices, store

#: Bound of a language's labelled sample, and the lengths that are taken first.
SAMPLE_CHARS, SAMPLE_DOCS, PREFERRED = 24_000, 400, (300, 3000)
#: Parts that a language's rows are dealt into before the sample is taken.
PARTS = 32
BLOCK = 2048
#: Characters of a language that have columns of their own in its table.
COLUMNS = 63
#: Tables of one broadcast.
TABLE_BYTES = 400_000_000


def normalised(text: str) -> str:
    """Lower-cased letters and single spaces."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """One language's automaton over the characters' numbers, 0 for characters of no sample.

    Row r of ``table`` has a state's dense transitions, as row numbers times the row width; 0 is none, and row 0
    has none. ``column`` maps a character to its column, 0 for others; their transitions are in ``keys`` and ``targets``.
    ``again`` is where each character leads from the root.
    """

    def __init__(self, symbols: list[int], characters: int):
        counts = Counter(symbols)
        dense = sorted((c for c in counts if c), key=lambda c: (-counts[c], c))[:COLUMNS]
        self.column = np.zeros(characters + 1, np.int32)
        self.column[dense] = np.arange(1, len(dense) + 1)
        self.width = len(dense) + 1
        self.characters = characters + 1
        auto = suffix_automaton(symbols)
        self.table = np.zeros((len(auto) + 1) * self.width, np.int32)
        sparse: dict[int, int] = {}
        for state, moves in enumerate(auto, 1):
            for c, to in moves.items():
                row = (to + 1) * self.width
                if c and self.column[c]:
                    self.table[state * self.width + self.column[c]] = row
                elif c:
                    sparse[state * self.characters + c] = row
        self.keys = np.array(sorted(sparse), np.int64)
        self.targets = np.array([sparse[k] for k in self.keys.tolist()], np.int32)
        self.again = np.zeros(self.characters, np.int32)
        for c, to in auto[0].items():
            if c:
                self.again[c] = (to + 1) * self.width
        self.bits = float(np.log2(max(2, len(symbols))))

    def size(self) -> int:
        return self.table.nbytes + self.keys.nbytes + self.targets.nbytes

    def step(self, state: np.ndarray, column: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next rows, 0 where the phrase ends."""
        to = self.table[state + column]
        if len(self.keys):
            rare = np.flatnonzero((column == 0) & (symbol > 0))
            if len(rare):
                key = (state[rare] // self.width).astype(np.int64) * self.characters + symbol[rare]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[rare] = np.where(self.keys[at] == key, self.targets[at], 0)
        return to


class Languages:
    """The automata of some languages and the numbers of their characters."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        texts = {n: " ".join(filter(None, map(normalised, samples[n]))) for n in self.names}
        self.code = {c: i for i, c in enumerate(sorted(set().union(*texts.values())), 1)}
        self.automata = [Automaton([self.code[c] for c in texts[n]], len(self.code)) for n in self.names]
        self.lookup = np.zeros(0, np.int32)

    def prepare(self) -> None:
        """Per-worker table from lower-cased code points: -1 no letter, 0 other letter, else a character's number."""
        look = np.full(sys.maxunicode + 1, -1, np.int32)
        look[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = 0
        for c, k in self.code.items():
            if c != " ":
                look[ord(c)] = k
        self.lookup = look

    def symbols(self, text: str) -> np.ndarray:
        """Numbers of the characters of the normalised text."""
        sym = self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = sym < 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]  # the first of a run of gaps stays as the space
        sym = sym[keep]
        if len(sym) and sym[0] < 0:
            sym = sym[1:]
        if len(sym) and sym[-1] < 0:
            sym = sym[:-1]
        return np.where(sym < 0, self.code.get(" ", 0), sym)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language, [text, language]."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        blocks = [-(-len(t) // BLOCK) for t in texts]
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return out
        lanes = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        lens = np.array([len(lanes[i]) for i in order])
        grid = np.zeros((int(lens[0]), len(lanes)), np.int32)
        for col, i in enumerate(order):
            grid[: lens[col], col] = lanes[i]
        live = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left")  # lanes longer than t
        place = np.empty(len(lanes), np.int64)
        place[order] = np.arange(len(lanes))
        # the lane that goes on where a lane ends, in the order of the grid; -1 at the end of a text
        follows = np.full(len(lanes), -1, np.int64)
        more = np.flatnonzero(owner[1:] == owner[:-1])
        follows[place[more]] = place[more + 1]
        for j, auto in enumerate(self.automata):
            count = _parse(auto, grid, lens, live, follows)
            np.add.at(out[:, j], owner[order], count)
        return out


def _parse(auto: Automaton, grid: np.ndarray, lens: np.ndarray, live: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that start in each lane when lanes that follow each other are one text."""
    n = len(lens)
    columns = auto.column[grid]
    starts = np.zeros(grid.shape, bool) if (follows >= 0).any() else None
    state, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for t in range(len(grid)):
        m = live[t]
        symbol = grid[t, :m]
        to = auto.step(state[:m], columns[t, :m], symbol)
        stuck = np.flatnonzero(to == 0)
        to[stuck] = auto.again[symbol[stuck]]
        count[stuck] += 1
        if starts is not None:
            starts[t, stuck] = True
        state[:m] = to
    if starts is None:
        return count
    # enter the lanes that follow with the state before them, until the phrases start where they did
    todo = np.flatnonzero(follows >= 0)
    while len(todo):
        lane, now = follows[todo], state[todo].copy()
        changed = []
        t = 0
        while len(lane):
            over = lens[lane] == t
            if over.any():  # no common start in the whole lane: what follows it begins in another state
                ends = lane[over]
                changed.append(ends[state[ends] != now[over]])
                state[ends] = now[over]
                lane, now = lane[~over], now[~over]
                if not len(lane):
                    break
            symbol = grid[t, lane]
            to = auto.step(now, columns[t, lane], symbol)
            ended = to == 0
            to = np.where(ended, auto.again[symbol], to)
            before = starts[t, lane]
            count[lane] += ended.astype(np.int64) - before
            starts[t, lane] = ended
            on = ~(ended & before)
            lane, now = lane[on], to[on]
            t += 1
        todo = np.concatenate(changed) if changed else todo[:0]
        todo = todo[follows[todo] >= 0]
    return count


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """The training sample of each language, of bounded size."""
    rows = docs.where("lang is not null and text is not null").where(~held_out()).where(F.col("text").rlike(r"\p{L}"))
    n = F.length("text")
    short, long = PREFERRED
    rank = F.when(n.between(short, long), 0).otherwise(F.when(n < short, short - n).otherwise(n))
    keyed = rows.select("lang", "doc_id", n.alias("n"), rank.alias("rank"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("f"))
    order = [F.col(c) for c in ("rank", "h", "doc_id", "f")]
    # in parts first: the last window has PARTS x SAMPLE_DOCS rows of a language at most, however many tasks there are
    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= SAMPLE_DOCS)

    parts = ranked(keyed.withColumn("part", F.pmod(F.xxhash64("f", "h"), F.lit(PARTS))), "lang", "part").drop("r", "part")
    first = ranked(parts, "lang")
    first = first.groupBy("lang", "doc_id", "f", "n").agg(F.min("r").alias("r"))  # equal rows count once
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = store(first.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).select("lang", "doc_id", "f", "r"), "lang-sample")
    wanted = picked.select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), "f", "r")
    same = (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("f"))
    found = rows.select("lang", "doc_id", "text").join(F.broadcast(wanted), same).select("lang", "r", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    out: dict[str, dict[int, str]] = {}
    for r in found.dropDuplicates(["lang", "r"]).orderBy("lang", "r").collect():
        out.setdefault(r.lang, {})[r.r] = r.text
    return {k: list(v.values()) for k, v in out.items() if any(map(normalised, v.values()))}


def groups(samples: dict[str, list[str]]) -> list[Languages]:
    """The languages in groups whose tables take ``TABLE_BYTES`` together, or one language."""
    out: list[dict[str, list[str]]] = [{}]
    held = 0
    for n in sorted(samples):
        size = 2 * min(SAMPLE_CHARS, sum(map(len, samples[n]))) * (COLUMNS + 1) * 4
        if out[-1] and held + size > TABLE_BYTES:
            out.append({})
            held = 0
        out[-1][n] = samples[n]
        held += size
    return [Languages(x) for x in out]


def predicted(docs: DataFrame, parts: list[Languages]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    # costs of the languages seen so far: bits per character, least of them, its name, and the sum of all weights
    schema = f"doc_id {kind}, text string, least double, best string, weight double"
    start = [F.lit(None).cast("double").alias("least"), F.lit("und").alias("best"), F.lit(0.0).alias("weight")]
    df = docs.select("doc_id", "text", *start)
    for languages in parts:
        shared = spark.sparkContext.broadcast(languages)

        def make(shared=shared):
            lang = shared.value
            if not len(lang.lookup):
                lang.prepare()
            bits = np.array([a.bits for a in lang.automata])

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column("text").to_pylist()
                least, best, weight = (batch.column(c).to_pylist() for c in ("least", "best", "weight"))
                for a, b in slices([len(t or "") for t in texts]) if lang.names else ():
                    sym = [lang.symbols(t or "") for t in texts[a:b]]
                    lens = np.array([len(x) for x in sym])
                    cost = lang.phrases(sym) * bits / np.maximum(1, lens)[:, None]
                    won = np.argmin(cost, axis=1)
                    low = cost.min(axis=1)
                    total = np.exp2(low[:, None] - cost).sum(axis=1)
                    for i in np.flatnonzero(lens).tolist():
                        old, new, k = least[a + i], float(low[i]), a + i
                        if old is None or new < old:
                            # weights are relative to the least cost
                            weight[k] = float(total[i]) + (weight[k] * 2.0 ** (new - old) if old is not None else 0.0)
                            least[k], best[k] = new, lang.names[won[i]]
                        else:
                            weight[k] += float(total[i]) * 2.0 ** (old - new)
                arrays = [batch.column("doc_id"), batch.column("text"), pa.array(least, pa.float64()), pa.array(best, pa.string()), pa.array(weight, pa.float64())]
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "least", "best", "weight"])

            return work

        df = map_batches(df, schema, make)
    score = F.when(F.col("weight") > 0, 1 / F.col("weight")).otherwise(0.0)
    return df.select("doc_id", held_out().alias("held_out"), F.col("best").alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled part of ``docs`` and predict the language of every whole text."""
    return predicted(docs, groups(sample(docs)))
