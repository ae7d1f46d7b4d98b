"""Suffix-array dedup: remove bytes of strings that also start in a document with a smaller id.

A string is ``LENGTH`` bytes. Sharding: every string has an anchor, its ``GRAM`` bytes of smallest hash (the first
of equals); neighbouring strings with the same anchor form a segment. Equal strings have equal anchors,
so a shard that holds all segments of an anchor decides about their strings alone.

1. Segments are compared by packed hashes of anchor and content, by buckets of anchors. Of equal segments,
   all but those of the smallest document are removed whole. A batch of documents does that for its
   own segments first, so a passage of a third of all documents reaches its bucket once a batch.
2. What is left of an anchor with several different segments in different documents is cut out of the texts, but for
   segments whose 33 bytes left and right of the anchor's start are in no segment of another document: in a large
   corpus most anchors occur again, most of these bytes don't. Anchors that a segment holds twice leave nothing out.
   Each shard of such segments gets a suffix array by induced sorting and its permuted common prefixes; runs
   of suffixes with common prefixes of ``LENGTH`` bytes are equal strings, and all but those of
   the smallest document are removed. Segments whose 33 bytes left or right of the anchor's middle
   occur in no other segment of the shard can't share a string and are left out of the array.
3. The spans meet their documents, and the bytes are cut.

An anchor with more than ``HOT`` different segments (the edges of a very common passage) would fill one
shard: its segments are dealt out as single strings and grouped by content, which is the same decision
without an array. Shards hold about ``SHARD_BYTES``, whatever the input.

Segments are the same if 64-bit hashes of their contents are and their anchors are; strings are compared
byte by byte. Edge cases: null text counts as empty; a document without a long string keeps all; texts under one
doc_id keep what they share, as no id is smaller; a null doc_id neither removes nor is removed from;
very long texts are one row. Text is UTF-8 bytes, so kept bytes may start or end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import map_batches, release, store
from sievework.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 16
#: A string holds so many bytes on one side of its anchor at least.
HALF = (LENGTH - GRAM) // 2
HOT = 4000
SHARD_BYTES = 1_000_000
#: Anchors of one bucket when equal segments are looked for.
BUCKET_ANCHORS = 300_000
BATCH_BYTES = 4_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(_M1), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place."""
    h = raw.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:  # GRAM is a power of two
        h = h[:-size] * _M1 + h[size:]
        h ^= h >> np.uint64(29)
        h *= _M2
        size *= 2
    h ^= h >> np.uint64(32)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of all texts: anchor hash, content hash, text number, first string's start, number of strings, side keys."""
    lens = np.array([len(x) for x in texts], np.int64)
    none = np.zeros(0, np.int64)
    if int(lens.sum()) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.uint32), none.astype(np.uint32)
    h = _grams(np.frombuffer(b"".join(texts), np.uint8))
    w = LENGTH - GRAM + 1
    least, size = h, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    ends = np.cumsum(lens)
    own = np.repeat(np.arange(len(texts)), lens)
    n = len(least)
    inside = own[:n] == own[LENGTH - 1 : LENGTH - 1 + n]
    # the same least hash in neighbouring strings is one segment, also when it is another place's
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (own[1:n] != own[: n - 1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    good = inside[at]
    at, count = at[good], count[good]
    # a content's hash: the polynomial of its grams, moved to power 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_M1, len(h)))])
    content = _mix((total[at + count + (w - 1)] - total[at]) * _powers(_INVERSE, len(h))[at] + count.astype(np.uint64))
    return least[at], content, own[at], at - (ends - lens)[own[at]], count, *_sides(h, least[at], at, count)


#: Side keys that stand for an anchor at several places of its segment, and for a side that is too short.
SEVERAL, SHORT = 0, 1


def _sides(h: np.ndarray, anchor: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each segment: hashes of its anchor with the HALF bytes left and right of it."""
    w = LENGTH - GRAM + 1
    high = (h >> np.uint64(32)).astype(np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(high, w)
    mine = (anchor >> np.uint64(32)).astype(np.uint32)[:, None]
    # an anchor of one place is in the first and the last string of the segment
    first, last = windows[at] == mine, windows[at + count - 1] == mine
    a = at + first.argmax(axis=1)
    one = (np.count_nonzero(first, axis=1) == 1) & (np.count_nonzero(last, axis=1) == 1) & (a == at + count - 1 + last.argmax(axis=1))
    out = []
    for sign in (-1, 1):
        there = one & ((a - HALF >= at) if sign < 0 else (a + HALF + GRAM <= at + count + LENGTH - 1))
        key = np.where(one, np.uint32(SHORT), np.uint32(SEVERAL))
        key[there] = np.maximum((_side(h, a[there], sign) >> np.uint64(32)).astype(np.uint32), 2)
        out.append(key)
    return out


def _side(h: np.ndarray, at: np.ndarray, sign: int) -> np.ndarray:
    """Hashes of the anchors and the HALF bytes beside: grams at the anchor, at the far end of the half, and one between."""
    return _mix(_mix(h[at] * _M1 + h[at + sign * HALF]) * _M1 + h[at + sign * (HALF // 2)])


def _batched(batches, most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for k in range(0, b.num_rows, 64):
            held.append(b.slice(k, 64))
            size += held[-1].get_total_buffer_size() if b.num_rows <= 64 else held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Packed arrays of a row: anchor bits, content hash, differences of doc ids, text hash, start, strings, side keys.
_KINDS = {"h": "<u4", "c": "<u8", "d": "<i8", "f": "<i8", "p": "<i4", "w": "<i4", "l": "<u4", "r": "<u4"}


def _small(x: np.ndarray) -> bytes:
    """Differences in as few bytes as they need, after a byte that says how many."""
    step = np.diff(x, prepend=0)
    first, rest = step[:1].astype("<i8").tobytes(), step[1:]
    for kind, size in (("<u1", 1), ("<u2", 2), ("<u4", 4)):
        if not len(rest) or (rest.min() >= 0 and rest.max() < 1 << 8 * size):
            return bytes([size]) + first + rest.astype(kind).tobytes()
    return bytes([8]) + first + rest.astype("<i8").tobytes()


def _large(x: bytes) -> np.ndarray:
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[x[0]]
    return np.cumsum(np.concatenate([np.frombuffer(x[1:9], "<i8"), np.frombuffer(x[9:], kind).astype(np.int64)]))


def _shared(h: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, in order of value."""
    order = np.argsort(h)
    x = h[order]
    same = x[1:] == x[:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


def removed(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Segments of which an equal one is in a smaller document."""
    out = np.zeros(len(h), bool)
    idx = _shared(h)
    if len(idx):
        idx = idx[np.lexsort((d[idx], c[idx], h[idx]))]
        new = np.concatenate([[True], (h[idx[1:]] != h[idx[:-1]]) | (c[idx[1:]] != c[idx[:-1]])])
        out[idx] = d[idx] > d[idx[new]][np.cumsum(new) - 1]
    return out


def _beside(h: np.ndarray, side: np.ndarray, c: np.ndarray, d: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Segments (of ``among``) that have their anchor and the bytes on one side of it in common with another one of another document."""
    out = np.zeros(len(h), bool)
    idx = np.flatnonzero(among & (side > SHORT))
    key = h[idx].astype(np.uint64) << np.uint64(32) | side[idx]
    some = _shared(key) if len(idx) else idx
    if len(some):
        idx, key = idx[some], key[some]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        differ = np.minimum.reduceat(c[idx], at) != np.maximum.reduceat(c[idx], at)
        differ &= np.minimum.reduceat(d[idx], at) < np.maximum.reduceat(d[idx], at)
        out[idx] = differ[np.cumsum(new) - 1]
    return out


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, done, packed arrays): segments to compare, or ones that the batch has found removed."""

    def run(batches):
        for table in _batched(batches, BATCH_BYTES):
            ids, fps = np.array(table.column("doc_id").to_pylist(), np.int64), np.array(table.column("fp").to_pylist(), np.int64)
            texts = table.column("text").to_pylist()
            by_id = np.argsort(ids, kind="stable")
            h, c, own, p, w, left, right = segments([(texts[i] or "").encode("utf-8", "surrogatepass") for i in by_id])
            if not len(h):
                continue
            d, f = ids[by_id][own], fps[by_id][own]  # ascending
            gone = removed(h, c, d)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            rows: dict[str, list] = {k: [] for k in ("bucket", "done", *_KINDS)}
            for done in (False, True):
                idx = np.flatnonzero(gone == done)
                if done:  # any bucket will do
                    target = (np.arange(len(h)) // 20_000 % buckets).astype(np.int32)
                else:
                    target = bucket
                idx = idx[np.argsort(target[idx].astype(np.uint16) if buckets < 1 << 16 else target[idx], kind="stable")]
                cuts = np.flatnonzero(np.diff(target[idx], prepend=-1))[1:]
                for part in np.split(idx, cuts) if len(idx) else ():
                    rows["bucket"].append(int(target[part[0]]))
                    rows["done"].append(done)
                    rows["d"].append(_small(d[part]))
                    rows["f"].append(f[part].tobytes())
                    rows["p"].append(p[part].astype("<i4").tobytes())
                    rows["w"].append(w[part].astype("<i4").tobytes())
                    rows["h"].append(b"" if done else h[part].astype("<u4").tobytes())
                    rows["c"].append(b"" if done else c[part].tobytes())
                    rows["l"].append(b"" if done else left[part].tobytes())
                    rows["r"].append(b"" if done else right[part].tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), *[(k, pa.binary()) for k in _KINDS]]))

    return docs.mapInArrow(run, "bucket int, done boolean, " + ", ".join(f"{k} binary" for k in _KINDS))


#: What is known of a segment: removed whole, to be compared in a shard, or string by string.
REMOVED, SHARD, STRINGS = 0, 1, 2


def compared(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, fp, p, w, how) of all segments that are removed or have to be compared further."""

    def out(d, f, p, w, how):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(f), pa.array(p), pa.array(w.astype(np.int32)), pa.array(how.astype(np.int8))], names=["doc_id", "fp", "p", "w", "how"])

    def run(batches):
        held: dict[str, list] = {k: [] for k in _KINDS}
        bucket = None

        def flush():
            if not held["h"]:
                return
            h, c, d, f, p, w, left, right = [np.concatenate(held[k]) for k in _KINDS]
            for k in _KINDS:
                held[k].clear()
            idx = _shared(h)  # an anchor of one segment has nothing to compare
            if not len(idx):
                return
            h, c, d, f, p, w, left, right = (x[idx] for x in (h, c, d, f, p, w, left, right))
            order = np.lexsort((d, c, h))
            h, c, d, f, p, w, left, right = (x[order] for x in (h, c, d, f, p, w, left, right))
            anchor = np.concatenate([[True], h[1:] != h[:-1]])
            new = anchor | np.concatenate([[True], c[1:] != c[:-1]])
            gone = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            at = np.flatnonzero(anchor)
            group = np.cumsum(anchor) - 1
            kinds = np.add.reduceat(new.astype(np.int64), at)
            several = (kinds > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
            maybe = several[group] & ~gone
            maybe &= np.logical_or.reduceat(left == SEVERAL, at)[group] | _beside(h, left, c, d, maybe) | _beside(h, right, c, d, maybe)
            kinds = np.add.reduceat((new & maybe).astype(np.int64), at)
            how = np.where(gone, REMOVED, np.where(kinds[group] > HOT, STRINGS, SHARD))
            keep = gone | maybe
            yield out(d[keep], f[keep], p[keep], w[keep], how[keep])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("bucket", "done", *_KINDS)]
            for b, done, *blobs in zip(*cols, strict=True):
                arrays = {k: _large(x) if k == "d" else np.frombuffer(x, _KINDS[k]) for k, x in zip(_KINDS, blobs, strict=True)}
                if done:
                    yield out(arrays["d"], arrays["f"], arrays["p"], arrays["w"], np.zeros(len(arrays["d"])))
                    continue
                if b != bucket:
                    yield from flush()
                    bucket = b
                for k, x in arrays.items():
                    held[k].append(x)
        yield from flush()

    rows = _packed(docs, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, p int, w int, how tinyint")


def cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, fp, p, how, anchor, content) of the wanted segments in the documents' texts."""
    lists = wanted.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("p", "w", "how")).alias("s"))
    rows = docs.join(lists, ["doc_id", "fp"]).select("doc_id", "fp", "text", *[F.col(f"s.{c}").alias(c) for c in ("p", "w", "how")])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *[len(t) for t in texts]])[:-1]
            per = np.array(batch.column("p").value_lengths().to_pylist())
            own = np.repeat(np.arange(len(texts)), per)
            p, w, how = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "w", "how"))
            n = w + (LENGTH - 1)
            ends = np.cumsum(n)
            at = np.arange(int(n.sum())) + np.repeat(p + starts[own] - (ends - n), n)
            body = np.frombuffer(b"".join(texts), np.uint8)[at]
            first = ends - n
            grams = _grams(body)
            inner = n - GRAM + 1
            # least hash over the grams of each content
            stops = np.cumsum(inner)
            anchor = np.minimum.reduceat(grams[np.arange(int(inner.sum())) + np.repeat(first - (stops - inner), inner)], stops - inner)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            content = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
            ids, fps = (np.array(batch.column(c).to_pylist(), np.int64)[own] for c in ("doc_id", "fp"))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fps), pa.array(p.astype(np.int32)), pa.array(how.astype(np.int8)), pa.array(anchor.view(np.int64)), content], names=["doc_id", "fp", "p", "how", "anchor", "content"])

        return work

    return map_batches(rows, "doc_id bigint, fp bigint, p int, how tinyint, anchor bigint, content binary", make)


def _may_match(contents: list[bytes]) -> np.ndarray:
    """Contents of which an anchor, at any of its places, is found in another content with the bytes before or after it.

    A string holds LENGTH - GRAM bytes beside its anchor, so it holds half of them on one side.
    """
    n = np.array([len(x) for x in contents])
    ends = np.cumsum(n)
    first = ends - n
    h = _grams(np.frombuffer(b"".join(contents), np.uint8))
    inner = n - GRAM + 1
    stops = np.cumsum(inner)
    place = np.arange(int(inner.sum())) + np.repeat(first - (stops - inner), inner)
    least = np.minimum.reduceat(h[place], stops - inner)
    hit = h[place] == np.repeat(least, inner)
    at = place[hit]
    own = np.repeat(np.arange(len(n)), inner)[hit]
    keep = np.zeros(len(n), bool)
    for sign in (-1, 1):
        a = at + sign * HALF
        idx = np.flatnonzero((a >= first[own]) & (a + GRAM <= ends[own]))
        if not len(idx):
            continue
        key = _side(h, at[idx], sign)
        order = np.lexsort((own[idx], key))
        key, of = key[order], own[idx[order]]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        runs = np.flatnonzero(new)
        several = of[runs] != of[np.append(runs[1:], len(of)) - 1]
        keep[of[several[np.cumsum(new) - 1]]] = True
    return keep


def judge_shard(contents: list[bytes], owners: np.ndarray) -> list[list[int]]:
    """For each segment: flat runs of its strings that start in a segment of a smaller document."""
    out: list[list[int]] = [[] for _ in contents]
    kept = np.flatnonzero(_may_match(contents))
    if len(kept) < 2:
        return out
    contents, owners = [contents[i] for i in kept], owners[kept]
    t, starts, sa = suffix_array(contents)
    lens = np.array([len(x) for x in contents])
    source = np.repeat(np.arange(len(contents)), lens + 1)
    offset = np.arange(len(t)) - starts[source]
    whole = offset + LENGTH <= lens[source]
    prefix = common_prefixes(t, sa, LENGTH, whole)
    order = sa[whole[sa]]
    new = np.flatnonzero(prefix[order] < LENGTH)
    least = np.minimum.reduceat(owners[source[order]], new)
    run = np.zeros(len(order), np.int64)
    run[new[1:]] = 1
    earlier = np.zeros(len(t), bool)
    earlier[order] = least[np.cumsum(run)] < owners[source[order]]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], earlier.view(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2).tolist():
        k = source[a]
        out[kept[k]] += [int(a - starts[k]), int(b - starts[k])]
    return out


def judged(contents: DataFrame, shards: int) -> DataFrame:
    """(doc_id, fp, span) for the strings of segments (doc_id, fp, p, anchor, content) to remove."""

    def run(batches):
        held: list[tuple] = []
        shard = None

        def flush():
            if len(held) > 1:
                runs = judge_shard([x[0] for x in held], np.array([x[1] for x in held]))
                spans = [[x[3] + v + (LENGTH - 1) * (i % 2) for i, v in enumerate(r)] for x, r in zip(held, runs, strict=True)]
                some = [i for i, r in enumerate(runs) if r]
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([held[i][1] for i in some], pa.int64()), pa.array([held[i][2] for i in some], pa.int64()), pa.array([spans[i] for i in some], pa.list_(pa.int32()))],
                        names=["doc_id", "fp", "span"],
                    )
            held.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "content", "doc_id", "fp", "p")]
            for s, *row in zip(*cols, strict=True):
                if s != shard:
                    yield from flush()
                    shard = s
                held.append(tuple(row))
        yield from flush()

    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.select("shard", "content", "doc_id", "fp", "p").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id bigint, fp bigint, span array<int>")


def judged_strings(contents: DataFrame) -> DataFrame:
    """The same decision for the segments of hot anchors, string by string."""
    places = F.sequence(F.lit(0), F.length("content") - F.lit(LENGTH))
    strings = contents.select("doc_id", "fp", "p", "content", F.explode(places).alias("j")).select("doc_id", "fp", (F.col("p") + F.col("j")).alias("j"), F.col("content").substr(F.col("j") + 1, F.lit(LENGTH)).alias("s"))
    least = strings.groupBy("s").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("s", "least")
    found = strings.join(least, "s").where("least < doc_id")
    return found.select("doc_id", "fp", F.array(F.col("j"), F.col("j") + LENGTH).alias("span"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, spans): flat byte ranges to remove, unmerged, of the documents (doc_id, fp, text) that have some."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, round(size * 2 / (LENGTH - GRAM + 2) / BUCKET_ANCHORS))
    found = store(compared(docs, buckets), "dup-segments")
    release(spark)
    contents = store(cut_segments(docs, found.where(F.col("how") != REMOVED)), "dup-contents")
    release(spark)
    cut = contents.where(F.col("how") == SHARD)
    shards = max(least, round((cut.agg(F.sum(F.length("content"))).collect()[0][0] or 0) / SHARD_BYTES))
    whole = found.where(F.col("how") == REMOVED).select("doc_id", "fp", F.array(F.col("p"), F.col("p") + F.col("w") + (LENGTH - 1)).alias("span"))
    spans = whole.unionByName(judged(cut, shards)).unionByName(judged_strings(contents.where(F.col("how") == STRINGS)))
    spans = store(spans.groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("span")).alias("spans")), "dup-spans")
    release(spark)
    return spans


def merged(spans: list[int]) -> np.ndarray:
    """Maximal runs [start, end] of flat ranges."""
    x = np.array(spans, np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    first = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    at = np.flatnonzero(first)
    return np.stack([x[at, 0], reach[np.append(at[1:], len(x)) - 1]], axis=1)


def cut_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    ids = docs.where("doc_id is not null")
    # texts under one doc_id are told apart by a hash; it is left out where no id is used twice
    twice = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    fp = (F.xxhash64("text") if twice else F.lit(0).cast("bigint")).alias("fp")
    spans = removed_spans(ids.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), fp, "text"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "spans")
    same = F.col("doc_id") == F.col("__id")
    rows = docs.join(spans, same & (F.xxhash64("text") == F.col("__fp")) if twice else same, "left").select("doc_id", "text", "spans")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merged(spans).tolist() if spans else []
                digest, last = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(raw[last:a])
                    last = b
                digest.update(raw[last:])
                for c, x in zip(out, (len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest()), strict=True):
                    c.append(x)
            arrays = [pa.array(x, pa.string() if k == 3 else pa.int64()) for k, x in enumerate(out)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return work

    return map_batches(rows, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", make)
