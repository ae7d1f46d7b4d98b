"""MinHash near-dedup: a chosen-path set similarity join.

Every document becomes the set of its distinct word shingles. Equal sets are collapsed to one vertex, and a
vertex has a MinHash sketch of ``SKETCH`` coordinates. ``TREES`` independent trees branch the vertices: a node
selects coordinates of the sketch (1 / SIMILARITY of them on average, at least one) and deals its vertices to children by
the minwise token there. Nodes of one vertex end; nodes of up to ``NODE`` vertices are compared exhaustively on
their sketches; larger ones branch again. After ``DEPTH`` levels they are dealt into blocks of that size for the first rounds (their
vertices agree on all selected tokens; every tree deals anew), and compared whole at the end. A pair of similarity
0.8 misses a tree with a probability of 0.16 to 0.36, by the depth of its node, and all trees with less than 0.00001.

Candidates are pairs of different components whose sketches agree enough that a pair of similarity 0.8 is
missed with a probability below 0.0001 in one comparison. They are confirmed on the full sets, the
components are contracted, and the next round compares what is still apart: first the 2 and 4 best partners of
each vertex in a node, then all of them, for which a node's undecided texts are sent to it once. So a group of
near copies costs a few links per copy, not all pairs, and no partner is left out.

Nodes that are still large at ``DEPTH`` (texts around one passage) form groups by the vertices that they share. All
pairs of a group's blocks are compared, each as one row of some task, but for blocks of the same component.
That work grows with the square of a group; components are contracted before it.

Node sizes come from counts; only nodes of bounded size are gathered in one task. Components are found by
contraction in DataFrame joins; no link, component or fingerprint comes to the driver.

Edge cases: null, empty and blank texts have the empty set, are linked with nothing and kept; texts of
fewer words than a shingle are one shingle; equal rows are linked; rows that share a doc_id are separate
documents of that id (``one_of_each`` keeps one row of a component in any case); a document with a null doc_id joins the component of those with its very set, but
links no others, is never the smallest, and isn't kept unless its set is empty. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import AT_TASK_END, fresh, map_batches, release, sized, slices, small_batches, store

SIMILARITY = 0.8
SKETCH = 96
TREES = 12
#: Coordinates that the roots of the trees select: one each, and a second one for every fourth tree.
ROOTS = [(t, t) for t in range(TREES)] + [(t, TREES + t // 4) for t in range(0, TREES, 4)]
NODE = 256
DEPTH = 3
#: Agreeing coordinates from which a pair is confirmed: 4.3 standard deviations below 0.8.
AGREE = 60
#: Partners of each vertex in a node that the first rounds confirm; the last round takes all.
PARTNERS = (2, 4)
#: Vertices, and their shingles, of a block of a large group.
BLOCK = 500
BLOCK_SHINGLES = 500_000
WORD_CACHE = 150_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * _MIX)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()
AT_TASK_END.append(_WORDS.clear)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    x = np.full(n, np.uint64(k))
    for i in range(k):
        x = x * _MIX + w[i : i + n]
    return np.unique(_mix(x))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash sketches [set, coordinate] of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SKETCH), np.uint32)
    for i, seed in enumerate(_SEEDS):
        v = (flat ^ seed) * (seed | np.uint64(1))
        out[:, i] = np.minimum.reduceat(v >> np.uint64(32), starts)
    return out


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, v (128-bit digest of the set, null if empty) and sketch of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            n, v, sk = [], [], []
            for a, b in slices([len(t or "") for t in texts]):
                sets = [shingles(t, size) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full).astype("<u4")) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    v.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None)
                    sk.append(next(rows).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(v, pa.binary()), pa.array(sk, pa.binary())], names=["doc_id", "n_shingles", "v", "sketch"])

        return work

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_shingles bigint, v binary, sketch binary", make)


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _rows(nodes: np.ndarray, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64), pa.int64()), pa.array(v, pa.binary())], names=["node", "v"])


def _roots(vertices: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            grid = _grid(batch.column("sketch"))
            v = batch.column("v").to_pylist()
            nodes = [_mix(_mix(grid[:, c].astype(np.uint64) + np.uint64((c + 1) << 32)) + np.uint64(t)) for t, c in ROOTS]
            return _rows(np.concatenate(nodes), v * len(ROOTS))

        return work

    return map_batches(vertices.select("v", "sketch"), "node bigint, v binary", make)


def _branch(rows: DataFrame) -> DataFrame:
    """Children of the nodes in (node, v, sketch): by one selected coordinate, or by two for a part of the nodes."""
    first = len(ROOTS)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            grid = _grid(batch.column("sketch"))
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            v = batch.column("v").to_pylist()
            line = np.arange(len(v))
            out, keys = [], []
            for k in (1, 2):
                pick = _mix(node + np.uint64(k * int(_MIX) & (1 << 64) - 1))
                at = (pick % np.uint64(SKETCH - first)).astype(np.int64) + first
                child = _mix(node ^ _mix(grid[line, at].astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1) << np.uint64(32))))
                # 1 / SIMILARITY - 1 of the nodes select a second coordinate
                chosen = line if k == 1 else np.flatnonzero((pick >> np.uint64(40)) % np.uint64(1000) < np.uint64(round(1000 / SIMILARITY - 1000)))
                out.append(child[chosen])
                keys += [v[i] for i in chosen]
            return _rows(np.concatenate(out), keys)

        return work

    return map_batches(rows.select("node", "v", "sketch"), "node bigint, v binary", make)


def leaves(vertices: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, v) of the nodes and blocks of 2 to NODE vertices, and of the nodes that are larger after DEPTH levels."""
    frontier, out, rest = store(_roots(vertices), "near-level"), [], None
    for depth in range(1, DEPTH + 1):
        counts = frontier.groupBy("node").agg(F.count("*").alias("size")).where("size >= 2")
        sized = frontier.join(counts, "node")
        out.append(sized.where(F.col("size") <= NODE).select("node", "v"))
        large = store(sized.where(F.col("size") > NODE), "near-large")
        if large.isEmpty():
            break
        if depth == DEPTH:
            blocks = F.ceil(F.col("size") / F.lit(NODE // 2))
            out.append(large.select(F.xxhash64("node", F.pmod(F.xxhash64("v", "node"), blocks)).alias("node"), "v"))
            rest = large.select("node", "v")
            break
        frontier = store(_branch(large.join(vertices.select("v", "sketch"), "v")), "near-level")
    return store(reduce(DataFrame.unionByName, out), "near-leaves"), rest


def _close(sk: np.ndarray, comp: list, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vertex of a node with candidates: itself, they, and how many coordinates agree."""
    code = {c: i for i, c in enumerate(dict.fromkeys(comp))}
    label = np.array([code[c] for c in comp])
    for i in range(0, len(sk) if len(code) > 1 else 0, 32):
        agree = (sk[i : i + 32, None, :] == sk[None, :, :]).sum(axis=2)
        lo, hi = np.minimum(size[i : i + 32, None], size[None, :]), np.maximum(size[i : i + 32, None], size[None, :])
        good = (agree >= AGREE) & (label[i : i + 32, None] != label[None, :]) & (lo * 100 >= hi * round(100 * SIMILARITY))
        for r in np.flatnonzero(good.any(axis=1)):
            found = np.flatnonzero(good[r])
            yield i + int(r), found, agree[r, found]


def _by_node(members: DataFrame, columns: tuple[str, ...], schema: str, work) -> DataFrame:
    """``work`` on the distinct rows of each node; it returns columns of the schema's types."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]

    def run(batches):
        held: list[tuple] = []
        node = None

        def flush():
            if len(held) > 1:
                out = work(node, sorted(set(held)))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
            held.clear()

        for batch in batches:
            for x, *row in zip(*[batch.column(c).to_pylist() for c in ("node", *columns)], strict=True):
                if x != node:
                    yield from flush()
                    node = x
                held.append(tuple(row))
        yield from flush()

    small_batches(members.sparkSession)
    return members.select("node", *columns).repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, list, np.ndarray]:
    return np.frombuffer(b"".join([r[3] for r in rows]), np.uint8).reshape(-1, SKETCH), [r[1] for r in rows], np.array([r[2] for r in rows])


def candidates(members: DataFrame, partners: int) -> DataFrame:
    """Distinct (a, b): the best partners in other components of the vertices in (node, v, comp, n, low)."""

    def work(node, rows):
        pairs = set()
        for a, found, agree in _close(*_arrays(rows)):
            for b in found[np.argsort(-agree, kind="stable")[:partners]].tolist():
                pairs.add((a, b) if a < b else (b, a))
        return [rows[a][0] for a, _ in sorted(pairs)], [rows[b][0] for _, b in sorted(pairs)]

    return _by_node(members, ("v", "comp", "n", "low"), "a binary, b binary", work).distinct()


def undecided(members: DataFrame) -> DataFrame:
    """(node, v) of the vertices that have a candidate in another component of their node."""

    def work(node, rows):
        ends = sorted({x for a, found, _ in _close(*_arrays(rows)) for x in (a, *found.tolist())})
        return [node] * len(ends), [rows[x][0] for x in ends]

    return _by_node(members, ("v", "comp", "n", "low"), "node bigint, v binary", work)


def exhaustive(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Distinct links (a, b) among all candidates of (node, v, comp, n, low), on the full sets.

    A text is sent once for each node that it is undecided in, so rows grow with the vertices, not with pairs.
    """
    least = round(100 * SIMILARITY)

    def work(node, rows):
        sets = [shingles(r[4], size) for r in rows]
        up = list(range(len(rows)))
        first: dict = {}
        for i, r in enumerate(rows):
            up[i] = first.setdefault(r[1], i)

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        links = []
        for a, found, _ in _close(*_arrays(rows)):
            for b in found.tolist():
                if find(a) == find(b):
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    up[max(find(a), find(b))] = min(find(a), find(b))
                    links.append((a, b))
        return [rows[a][0] for a, _ in links], [rows[b][0] for _, b in links]

    return _by_node(members.join(texts, "v"), ("v", "comp", "n", "low", "text"), "a binary, b binary", work).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs whose full sets are similar; texts (v, text) are shorter to send than sets, which are made anew."""
    least = round(100 * SIMILARITY)
    joined = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("y")), "b")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            before, p = None, None
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if x != before:
                    before, p = x, shingles(x, size)
                q = shingles(y, size)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= least * (len(p) + len(q) - both))
            return batch.select(["a", "b"]).filter(pa.array(good))

        return work

    return map_batches(joined.select("a", "b", "x", "y"), "a binary, b binary", make)


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (v, comp) after joining the components that the stored links (a, b) connect.

    Every step sends each component to its smallest neighbour and contracts the links; what the steps
    decided is applied to the labels once. Frames of few links are broadcast, after their rows are counted.
    """
    half = labels.join(sized(links), F.col("v") == F.col("a")).select(F.col("comp").alias("p"), "b")
    half = store(half, "near-edges")
    edges = labels.join(sized(half), F.col("v") == F.col("b")).select("p", F.col("comp").alias("q"))
    edges = store(edges.where("p <> q").distinct(), "near-edges")
    steps = []

    def moved(df: DataFrame, c: str, up: DataFrame) -> DataFrame:
        to = up.select(F.col("p").alias("__from"), F.col("to").alias("__to"))
        return df.join(to, F.col(c) == F.col("__from"), "left").withColumn(c, F.coalesce("__to", c)).drop("__from", "__to")

    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("q").alias("p"), F.col("p").alias("q")))
        up = sized(store(both.groupBy("p").agg(F.least(F.col("p"), F.min("q")).alias("to")).where("p <> to"), "near-parents"))
        steps.append(up)
        edges = store(moved(moved(edges, "p", up), "q", up).where("p <> q").distinct(), "near-edges")
    for up in steps:
        labels = moved(labels, "comp", up)
    return store(labels.select("v", "comp"), "near-labels") if steps else labels


def grouped(large: DataFrame) -> DataFrame:
    """(v, grp) of the vertices of the large nodes (node, v); nodes with a common vertex are in one group."""
    first = sized(store(large.groupBy("node").agg(F.min("v").alias("b")), "near-firsts"))
    links = store(large.join(first, "node").select(F.col("v").alias("a"), "b").where("a <> b").distinct(), "near-links")
    labels = store(large.select("v", F.col("v").alias("comp")).distinct(), "near-labels")
    return contracted(labels, links).withColumnRenamed("comp", "grp")


def block_pairs(members: DataFrame, *columns: str) -> DataFrame:
    """(x, y): lists of the columns' structs for all pairs of blocks, each with itself too, of the groups in
    (grp, v, comp, n). A component that fills a block has its own ones, which aren't paired with each other.
    """
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("m"))
    own = sized(store(sizes.where(F.col("m") >= BLOCK).select("grp", "comp", F.col("comp").alias("part")), "near-parts"))
    rows = members.join(own, ["grp", "comp"], "left").withColumn("part", F.coalesce("part", F.lit(b"")))
    need = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)))
    rows = rows.join(sized(store(rows.groupBy("grp", "part").agg(need.alias("blocks")), "near-parts")), ["grp", "part"])
    number = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("string").cast("binary")
    rows = rows.withColumn("block", F.concat("grp", "part", number))
    blocks = store(rows.groupBy("block").agg(F.first("grp").alias("grp"), F.first("part").alias("part"), F.collect_list(F.struct(*columns)).alias("rows")), "near-blocks")
    ids = blocks.select("block", "grp", "part")
    left, right = (ids.select("grp", F.col("block").alias(f"b{k}"), F.col("part").alias(f"part{k}")) for k in (1, 2))
    apart = (F.col("part1") != F.col("part2")) | (F.length("part1") == 0)
    pairs = left.join(right, "grp").where((F.col("b1") <= F.col("b2")) & apart).select("b1", "b2")
    x, y = (blocks.select(F.col("block").alias(f"b{k}"), F.col("rows").alias(c)) for k, c in ((1, "x"), (2, "y")))
    return pairs.join(x, "b1").join(y, "b2").repartition("b1", "b2").select("x", "y")


def _cross(x: pa.StructArray, y: pa.StructArray) -> np.ndarray:
    """Places in x and y of the candidates: vertices of different components whose sketches and sizes agree."""
    (sx, cx, nx), (sy, cy, ny) = (
        (np.frombuffer(b"".join(b.field("low").to_pylist()), np.uint8).reshape(-1, SKETCH), np.frombuffer(b"".join(b.field("comp").to_pylist()), "<u8").reshape(-1, 2), b.field("n").to_numpy(zero_copy_only=False))
        for b in (x, y)
    )
    agree = np.zeros((len(sx), len(sy)), np.uint8)
    for k in range(SKETCH):
        agree += sx[:, k, None] == sy[None, :, k]
    good = (agree >= AGREE) & (cx[:, None, :] != cy[None, :, :]).any(axis=2)
    good &= np.minimum(nx[:, None], ny) * 100 >= np.maximum(nx[:, None], ny) * round(100 * SIMILARITY)
    return np.argwhere(good)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """How many of the sorted tokens each set of a has in common with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(t) for t in s])) for s in (a, b)]
    at = [np.searchsorted(tokens, f) for f, _ in flat]
    for i, (f, own) in enumerate(flat):
        hit = tokens[np.minimum(at[i], len(tokens) - 1)] == f
        flat[i], at[i] = (f[hit], own[hit]), at[i][hit]
    for k in range(0, len(tokens), 2048):
        has = []
        for i, s in enumerate((a, b)):
            here = (at[i] >= k) & (at[i] < k + 2048)
            m = np.zeros((len(s), 2048), np.float32)
            m[flat[i][1][here], at[i][here] - k] = 1
            has.append(m)
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def _similar(places: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Those of the candidate places whose sets are similar."""
    i, j = places.T
    na, nb = (np.array([len(t) for t in s]) for s in (a, b))
    rows, cols = np.unique(i), np.unique(j)
    both = np.empty(len(places), np.int64)
    tokens, count = np.unique(np.concatenate([*(a[k] for k in rows), *(b[k] for k in cols)]), return_counts=True)
    tokens = tokens[count > 1]
    # a merge takes some 10 ns a shingle, a product some 0.1 ns a token and pair
    if len(tokens) and len(rows) * len(cols) * len(tokens) < 100 * int((na[i] + nb[j]).sum()):
        both[:] = _overlaps([a[k] for k in rows], [b[k] for k in cols], tokens)[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    else:
        both[:] = [len(np.intersect1d(a[p], b[q], assume_unique=True)) for p, q in places.tolist()]
    return places[100 * both >= round(100 * SIMILARITY) * (na[i] + nb[j] - both)]


def undecided_of_groups(members: DataFrame) -> DataFrame:
    """Distinct v with a candidate in another component of their group in (grp, v, comp, n, low)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = set()
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                places = _cross(x.values, y.values)
                for side, at in ((x.values, places[:, 0]), (y.values, places[:, 1])):
                    found.update(side.field("v").take(pa.array(np.unique(at))).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["v"])

        return work

    return map_batches(block_pairs(members, "v", "comp", "n", "low"), "v binary", make).distinct()


def links_of_groups(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Distinct links (a, b) among all candidates of the groups in (grp, v, comp, n, low), on the full sets."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            links = set()
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                places = _cross(x.values, y.values)
                if not len(places):
                    continue
                sets = [[shingles(t, size) for t in side.values.field("text").to_pylist()] for side in (x, y)]
                v, w = (side.values.field("v").to_pylist() for side in (x, y))
                # one link of two components is enough
                seen = {}
                c, d = (side.values.field("comp").to_pylist() for side in (x, y))
                for i, j in _similar(places, *sets).tolist():
                    seen.setdefault((c[i], d[j]) if c[i] < d[j] else (d[j], c[i]), (v[i], w[j]))
                links.update((a, b) if a < b else (b, a) for a, b in seen.values())
            rows = sorted(links)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["a", "b"])

        return work

    rows = members.join(texts, "v")
    return map_batches(block_pairs(rows, "v", "comp", "n", "low", "text"), "a binary, b binary", make).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(v, text) for the vertices (v, rep): the text of a document with that set."""
    ids = store(wanted.select(F.col("rep").alias("doc_id")).distinct(), "near-ids")
    rows = docs.select("doc_id", "text").join(sized(ids), "doc_id", "left_semi")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = [hashlib.blake2b(shingles(t, size).astype("<u8").tobytes(), digest_size=16).digest() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), batch.column("text")], names=["v", "text"])

        return work

    return map_batches(rows, "v binary, text string", make)


def found_components(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, v) of every document, and (v, rep, comp) of every set: its smallest doc_id and its component."""
    found = store(profiles(docs, size), "near-profiles")
    vertices = store(
        found.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "near-vertices",
    )
    nodes, large = leaves(vertices)
    labels = store(nodes.select("v").distinct().select("v", F.col("v").alias("comp")), "near-labels")
    release(docs.sparkSession)
    # one byte of each coordinate is enough to compare
    low = F.unhex(F.regexp_replace(F.hex("sketch"), "(..)......", "$1"))
    light = vertices.join(labels.select("v"), "v", "left_semi").select("v", "n", low.alias("low"))
    light = store(light, "near-light")

    def mixed_members() -> DataFrame:
        rows = nodes.join(labels, "v")
        mixed = rows.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("node")
        return rows.join(mixed, "node", "left_semi").join(light, "v").select("node", "v", "comp", "n", "low")

    def texts_for(wanted: DataFrame) -> DataFrame:
        return store(texts_of(docs, vertices.select("v", "rep").join(wanted, "v"), size), "near-texts")

    for partners in (*PARTNERS, None):
        if partners:
            pairs = store(candidates(mixed_members(), partners), "near-pairs")
            if pairs.isEmpty():
                break
            texts = texts_for(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct())
            links = confirmed(pairs, texts, size)
        else:
            members = store(mixed_members(), "near-members")
            open_ends = store(undecided(members), "near-undecided")
            if open_ends.isEmpty():
                break
            texts = texts_for(open_ends.select("v").distinct())
            links = exhaustive(members.join(open_ends, ["node", "v"], "left_semi"), texts, size)
        links = store(links, "near-links")
        release(docs.sparkSession)
        labels = contracted(labels, links)
        release(docs.sparkSession)
    if large is not None:
        rows = grouped(large).join(labels, "v")
        mixed = rows.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp")
        members = store(rows.join(sized(store(mixed, "near-mixed")), "grp", "left_semi").join(light, "v").select("grp", "v", "comp", "n", "low"), "near-members")
        open_ends = store(undecided_of_groups(members), "near-undecided")
        if not open_ends.isEmpty():
            links = links_of_groups(members.join(open_ends, "v", "left_semi"), texts_for(open_ends), size)
            labels = contracted(labels, store(links, "near-links"))
        release(docs.sparkSession)
    return found.select("doc_id", "n_shingles", "v"), vertices.join(labels, "v", "left").select("v", "rep", F.coalesce("comp", "v").alias("comp"))


def components(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; ``size`` words make a shingle."""
    return _named(*found_components(docs, size))


def _named(found: DataFrame, groups: DataFrame) -> DataFrame:
    smallest = groups.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = groups.join(smallest, "comp").select("v", "component_id")
    out = found.select("doc_id", "n_shingles", "v").join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("v").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def with_set(docs: DataFrame, size: int, name: str) -> DataFrame:
    """``docs`` and the digest of each row's set, null if it is empty."""
    schema = docs.withColumn(name, F.lit(None).cast("binary")).schema

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            v = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(v, pa.binary())], names=[*batch.schema.names, name])

        return work

    return map_batches(docs, schema, make)


def one_of_each(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with exactly one row of each component, and all rows whose set is empty; all columns.

    The row that stays has the component's smallest doc_id (a null one only if there is no other), then the
    smallest set; of equal such rows any one stays. Rows that share an id, or have none, are told apart by their sets.
    """
    found, groups = found_components(docs, size)
    groups = store(groups, "near-groups")
    named = _named(found, groups)
    ids = store(named.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("kept")).alias("gone")).where("gone or n > 1 or doc_id is null"), "near-removed")
    unclear = ids.where("n > 1 or doc_id is null")
    names = [F.col(f"`{c}`") for c in docs.columns]
    clear = docs.join(sized(ids.select("doc_id")), "doc_id", "left_anti").select(*names)
    if unclear.isEmpty():
        return clear
    v = fresh("set", docs.columns)
    shared = sized(store(unclear.where("doc_id is not null").select("doc_id"), "near-unclear"))
    rest = docs.join(shared, "doc_id", "left_semi").select(*names).unionByName(docs.where("doc_id is null"))
    rest = with_set(rest, size, v)
    order = F.struct(F.col("rep").isNull().alias("late"), F.col("rep").alias("id"), F.col("v").alias("set"))
    a, b = (fresh(x, rest.columns) for x in ("first_id", "first_set"))
    first = groups.groupBy("comp").agg(F.min(order).alias("w")).select(F.col("w.id").alias(a), F.col("w.set").alias(b))
    chosen = rest.join(first, (F.col(v) == F.col(b)) & F.col("doc_id").eqNullSafe(F.col(a)), "left_semi").dropDuplicates(["doc_id", v])
    blank = rest.where(F.col(v).isNull())
    # null ids never match the anti-join
    return clear.where("doc_id is not null").unionByName(blank.select(*names)).unionByName(chosen.select(*names))
