"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words become integers and feed one suffix automaton; training words stream through it and
the longest matching length is tracked at every word. A word is hit if it lies in an occurrence of a
window: ``window`` consecutive words of an item, or the whole of a shorter item.

Only runs of neighbouring word pairs that occur in some item are streamed: outside them the longest
match is below two words. The automaton is broadcast with the task; its size is bounded by
``BLOCK_BYTES`` of item text, beyond that the items are dealt into blocks and the documents pass one
automaton after the other (narrow passes, no shuffle).

Edge cases: null or wordless text has no words and no hits; a null or wordless item has no window;
an item with a null id hits words but is not listed; equal items all count; equal rows of documents
each give a row; further columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import fresh, map_batches

WINDOW = 10
#: Item text of one automaton.
BLOCK_BYTES = 16_000_000

_KEEP = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (ASCII letters and digits and all other characters above 0x7F) as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton of word sequences with item sets and short items for each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[int]] = [set()]
        self.ids = [i for i, _ in items]
        shorts: dict[int, list[tuple[int, int]]] = {}
        pairs: set[tuple[int, int]] = set()
        self.least = 2
        for k, (_, words) in enumerate(items):
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            if not codes:
                continue
            pairs.update(zip(codes, codes[1:], strict=False))
            last = 0
            for c in codes:
                last = self._extend(last, c, ends)
                ends[last].add(k)
            if len(codes) < window:
                shorts.setdefault(last, []).append((len(codes), k))
            if len(codes) == 1:
                self.least = 1
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        for v in reversed(order[1:]):
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        n = len(self.next)
        self.top = [-1] * n  # the state of a match's last `window` words
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order[1:]:
            up = self.link[v]
            self.short[v] = self.short[up] + tuple(shorts.get(v, ()))
            if self.length[v] >= window:
                self.top[v] = v if self.length[up] < window else self.top[up]
        self.items_of = {v: frozenset(ends[v]) for v in set(self.top) if v >= 0}
        base = len(self.vocab) + 1
        self.base = base
        self.pairs = np.array(sorted(a * base + b for a, b in pairs), dtype=np.int64)

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            ends.append(set())
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else split(p, q)
        return cur

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Start and end (exclusive) of the runs of words that can hold a window."""
        if self.least == 1:
            inside = codes > 0
        else:
            pair = codes[:-1].astype(np.int64) * self.base + codes[1:]
            pair[(codes[:-1] == 0) | (codes[1:] == 0)] = -1
            at = np.searchsorted(self.pairs, pair)
            good = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair if len(self.pairs) else np.zeros(len(pair), bool)
            inside = np.zeros(len(codes), bool)
            inside[:-1] |= good
            # a run of good pairs i..j covers words i..j+1; neighbouring runs stay apart
            edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
            return np.stack([edges[0::2], edges[1::2] + 1], axis=1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        return edges.reshape(-1, 2)

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (start, end exclusive) of a run, and the items with a window in it."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = n = 0
        for i, c in enumerate(codes):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(c, 0)
            n = n + 1 if v else 0
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                found |= self.items_of[self.top[v]]
            for size, k in self.short[v] if v else ():
                if size <= n:
                    spans.append((i + 1 - size, i + 1))
                    found.add(k)
        return spans, found


def scan_texts(automaton: ItemAutomaton, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: its number of words, merged hit spans in words, and the found items."""
    get, zero = automaton.vocab.get, 0
    codes: list[int] = [0]
    starts = []
    sizes = []
    for text in texts:
        words = words_of(text)
        starts.append(len(codes))
        sizes.append(len(words))
        codes.extend([get(w, zero) for w in words])
        codes.append(0)
    flat = np.array(codes, dtype=np.int32)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[int]] = [set() for _ in texts]
    runs = automaton.candidates(flat) if len(flat) > 1 and automaton.vocab else np.zeros((0, 2), np.int64)
    runs = runs[runs[:, 1] - runs[:, 0] >= automaton.least]
    owner = np.searchsorted(np.array(starts), runs[:, 0], side="right") - 1 if len(starts) else []
    for (a, b), d in zip(runs.tolist(), list(owner), strict=True):
        got, items = automaton.stream(codes[a:b])
        off = a - starts[d]
        found[d] |= items
        for s, e in sorted(got):
            s, e = s + off, e + off
            if spans[d] and s <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(e, spans[d][-1][1]))
            else:
                spans[d].append((s, e))
    return list(zip(sizes, spans, found, strict=True))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def build_automata(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[ItemAutomaton]:
    """One automaton for each block of items; a block holds ``block_bytes`` of text, or one longer item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    out: list[ItemAutomaton] = []
    block: list[tuple[str | None, list[bytes]]] = []
    held = 0
    for row in items.toLocalIterator():
        size = len(row.t.encode("utf-8", "surrogatepass"))
        if block and held + size > block_bytes:
            out.append(ItemAutomaton(block, window))
            block, held = [], 0
        block.append((row.i, words_of(row.t)))
        held += size
    out.append(ItemAutomaton(block, window))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, name: str = "hits") -> DataFrame:
    """All columns of ``docs`` and one more, ``name``: struct of n_words, flat word spans and distinct item ids."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {name}")
    spark = docs.sparkSession
    kind = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"
    df = docs.withColumn(name, F.lit(None).cast(kind))
    out_schema = df.schema
    for automaton in build_automata(benchmark, window):
        shared = spark.sparkContext.broadcast(automaton)

        def make(shared=shared):
            automaton = shared.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column("text").to_pylist()
                before = batch.column(name).to_pylist()
                rows = []
                for (n, spans, found), old in zip(scan_texts(automaton, texts), before, strict=True):
                    ids = {automaton.ids[k] for k in found} - {None}
                    if old:
                        flat = old["spans"]
                        spans = _merge(spans + list(zip(flat[0::2], flat[1::2], strict=True)))
                        ids |= set(old["items"])
                    rows.append({"n_words": n, "spans": [x for s in spans for x in s], "items": sorted(ids)})
                at = batch.schema.get_field_index(name)
                kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                return batch.set_column(at, pa.field(name, kind), pa.array(rows, type=kind))

            return work

        df = map_batches(df, out_schema, make)
    return df


def hit_table(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    h = find_hits(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.expr("cast(aggregate(hits.spans, struct(0L as s, 1L as sign), (a, x) -> struct(a.s - a.sign * x as s, -a.sign as sign)).s as bigint)")
    return h.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hits.items")), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


def _word_offsets(text: str) -> list[tuple[int, int]]:
    """Character ranges of the words of ``text``, in the order of ``words_of``."""
    flags = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.frombuffer(_KEEP, dtype=np.uint8) != 0x20
    inside = np.ones(len(flags), bool)
    low = flags < 128
    inside[low] = table[flags[low]]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [tuple(x) for x in edges.reshape(-1, 2).tolist()]


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Cut the hit spans out of the texts; documents hit over more than ``max_coverage`` of their words go.

    Columns are those of ``docs``. Texts without a hit stay as they are, nulls included; ``n_chars``, if
    there, is counted anew for cut texts. Columns of any name pass through.
    """
    names = docs.columns
    mark = fresh("hits", names)
    found = find_hits(docs, benchmark, window, mark)
    schema = docs.schema

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            keep, out = [], []
            counts = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for k, (text, h) in enumerate(zip(texts, batch.column(mark).to_pylist(), strict=True)):
                flat = h["spans"]
                hit = sum(flat[1::2]) - sum(flat[0::2])
                keep.append(not hit or hit <= max_coverage * h["n_words"])
                if hit:
                    at = _word_offsets(text)
                    last, parts = 0, []
                    for s, e in zip(flat[0::2], flat[1::2], strict=True):
                        parts.append(text[last : at[s][0]])
                        last = at[e - 1][1]
                    text = "".join(parts) + text[last:]
                    if counts is not None:
                        counts[k] = len(text)
                out.append(text)
            res = batch.select(names)
            res = res.set_column(names.index("text"), res.schema.field("text"), pa.array(out, res.schema.field("text").type))
            if counts is not None:
                f = res.schema.field("n_chars")
                res = res.set_column(names.index("n_chars"), f, pa.array(counts, f.type))
            return res.filter(pa.array(keep))

        return work

    return map_batches(found, schema, make)
