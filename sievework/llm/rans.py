"""Token-ID output: a static range asymmetric numeral system over shared frequency tables.

Every document is tokenised and ended by id 0. Ids are counted over the whole corpus into one frequency
table of ``1 << SCALE_BITS`` slots in which every id of the vocabulary has at least one. In ascending doc_id
order, runs of whole documents become segments; a segment's ids are cut into blocks of ``BLOCK`` ids, and
each block is coded by ``LANES`` interleaved 64-bit states that share one stream of 32-bit words.

File format: a Parquet dataset with one row per segment in the columns of ``FILE_SCHEMA``. ``payload`` holds
the blocks one after the other; for each block ``words`` gives its number of words, ``states`` the final states
(the checkpoint from which a decoder starts, LANES x 8 bytes) and ``checks`` the crc32 of its ids. Blocks
depend on nothing but the table, so they can be decoded in parallel; ``doc_ids`` and ``doc_tokens`` give the
documents. The table is a dataset beside it with a row for each id. Segments carry the number of their range
partition; the ids before a partition are summed over partitions (one number for each).

The vocabulary's words must not depend on where a piece stands: one that puts a space before every text is refused.

Edge cases: null and empty texts are one end id; a null doc_id sorts first; equal doc_ids stay
neighbours in the order of their ids' bytes; no documents give no rows; a checksum that differs on reading raises.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bpe import byte_letters
from sievework.llm.common import UNICODE_SPACE, map_batches, shared_dir, slices, small_batches, store

SCALE_BITS = 20
LANES = 64
BLOCK = 16384
#: Ids of a segment; one longer document makes a longer segment.
SEGMENT = 1 << 20
#: Pieces of text whose ids a worker remembers, and their characters and ids together; beyond either it starts anew.
CACHE, CACHE_SIZE = 1_500_000, 40_000_000
#: Bytes of token ids (two each) for one range partition.
PARTITION_BYTES = 48_000_000
_LOW = np.uint64(1 << 31)
_JOINED = ("  ", "\n ", " \n", "\n\n")
_RARE_SPACE = [c for c in UNICODE_SPACE if c not in " \n"]
_CHUNKS = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")

FILE_SCHEMA = (
    "part int, segment bigint, start bigint, doc_ids binary, doc_null binary, doc_tokens binary, n_ids bigint, "
    "words binary, states binary, checks binary, payload binary"
)


class PieceTokens:
    """Ids of texts through the tokenizers library, which sees each space-separated piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter, self.model = self.library.pre_tokenizer, self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        # a piece goes to the library whole if there is more to it than words and merges
        self.whole = self.library.normalizer is not None or any("<" not in t for t in self.special)
        with open(path, encoding="utf-8") as f:
            how = json.load(f)["pre_tokenizer"] or {}
        if any(k.get("add_prefix_space") or k.get("type") == "Metaspace" for k in (how, *how.get("pretokenizers", ()))):
            raise ValueError(f"{path}: a space is put before every piece")
        self.plain = how.get("type") == "ByteLevel" and how.get("use_regex")
        self._clear()

    def _clear(self):
        self.head, self.tail = _Index(self, ""), _Index(self, " ")
        self.words: dict[str, array] = {}
        self.pool, self.offsets, self.held = array("I"), array("q", [0]), 0

    def split(self, piece: str) -> list[str]:
        """The library's words of a piece in byte letters; plain words with a full stop or comma need no pattern."""
        if self.plain:
            core = piece[1:] if piece[:1] == " " else piece
            stop = core[-1:] if core[-1:] in (".", ",") else ""
            core = core[:-1] if stop else core
            if core.isalpha():
                word = core if core.isascii() else "".join([self.letters[b] for b in core.encode("utf-8", "surrogatepass")])
                if piece[0] == " ":
                    word = self.letters[0x20] + word
                return [word, stop] if stop else [word]
        return [w for w, _ in self.splitter.pre_tokenize_str(piece)]

    def ids_of(self, piece: str) -> array:
        """The library's ids of one piece, word by word."""
        if self.whole or "<" in piece and any(t in piece for t in self.special):
            return array("I", self.library.encode(piece, add_special_tokens=False).ids)
        out = array("I")
        for word in self.split(piece):
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(word)])
            out += ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.offsets) > CACHE or self.held + len(self.pool) > CACHE_SIZE:
            self._clear()
        at, sizes = array("i"), []
        head, tail = self.head, self.tail.__getitem__
        for text in texts:
            before = len(at)
            if any(x in text for x in _JOINED) or any(c in text for c in _RARE_SPACE):
                at.extend(map(head.__getitem__, _CHUNKS.findall(text)))
            elif text:
                # no token goes on into white space, so a text can be cut at single spaces and line ends
                for k, line in enumerate(text.split("\n")):
                    if k:
                        at.append(head["\n"])
                    pieces = line.split(" ")
                    if pieces[0]:
                        at.append(head[pieces[0]])
                    at.extend(map(tail, pieces[1:]))
            sizes.append(len(at) - before)
        place = np.frombuffer(at, np.int32) if len(at) else np.zeros(0, np.int32)
        offsets = np.array(self.offsets, dtype=np.int32)
        begin = offsets[place]
        lens = offsets[place + 1] - begin
        ends = np.cumsum(lens, dtype=np.int32)
        where = np.repeat(begin - (ends - lens), lens)
        where += np.arange(len(where), dtype=np.int32)
        ids = np.array(self.pool, dtype=np.uint32)[where]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Index(dict):
    def __init__(self, owner: PieceTokens, before: str):
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        at = self[piece] = len(owner.offsets) - 1
        owner.held += len(piece)
        owner.pool.extend(owner.ids_of(self.before + piece))
        owner.offsets.append(len(owner.pool))
        return at


_TOKENS: dict[str, PieceTokens] = {}


def piece_tokens(path: str) -> PieceTokens:
    if path not in _TOKENS:
        _TOKENS[path] = PieceTokens(path)
    return _TOKENS[path]


def quantised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that add up to 1 << bits, near proportion."""
    size = 1 << bits
    if len(counts) > size // 2:
        raise ValueError("the vocabulary is too large for the table")
    free = size - len(counts)
    total = max(1, int(counts.sum()))
    out = 1 + (counts.astype(object) * free // total).astype(np.int64)
    out[int(np.argmax(out))] += size - int(out.sum())
    return out


class Coder:
    """Vectorised rANS with the shared table; a block is an array of ids."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The words of each block in decoding order, and its states [block, lane]."""
        n = len(blocks)
        lens = np.array([len(b) for b in blocks])
        steps = -(-int(lens.max()) // LANES)
        grid = np.zeros((n, steps * LANES), dtype=np.uint32)
        for k, b in enumerate(blocks):
            grid[k, : len(b)] = b
        state = np.full((n, LANES), _LOW, dtype=np.uint64)
        words, owners = [], []
        lane = np.arange(LANES)
        for t in range(steps - 1, -1, -1):
            live = t * LANES + lane[None, :] < lens[:, None]
            sym = grid[:, t * LANES : (t + 1) * LANES]
            f, c = self.freq[sym], self.start[sym]
            full = live & (state >= f << (np.uint64(63) - self.bits))
            # lanes are read in ascending order, so they are written in descending order
            at = np.nonzero(full[:, ::-1])
            cols = LANES - 1 - at[1]
            words.append((state[at[0], cols] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append(at[0])
            state = np.where(full, state >> np.uint64(32), state)
            q = state // f
            state = np.where(live, (q << self.bits) + (state - q * f) + c, state)
        flat, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        cuts = np.cumsum(np.bincount(owner, minlength=n))
        return [x[::-1] for x in np.split(flat[order], cuts[:-1])], state

    def decode(self, words: list[np.ndarray], states: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        n = len(words)
        steps = -(-int(lens.max()) // LANES)
        stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
        state = states.copy()
        out = np.zeros((n, steps * LANES), dtype=np.uint32)
        mask = np.uint64((1 << int(self.bits)) - 1)
        lane = np.arange(LANES)
        for t in range(steps):
            live = t * LANES + lane[None, :] < lens[:, None]
            slot = state & mask
            sym = self.slot[slot]
            out[:, t * LANES : (t + 1) * LANES] = sym
            state = np.where(live, self.freq[sym] * (state >> self.bits) + slot - self.start[sym], state)
            need = live & (state < _LOW)
            rank = np.cumsum(need, axis=1)
            pos = np.minimum(at[:, None] + rank - 1, len(stream) - 1)
            state = np.where(need, state << np.uint64(32) | stream[pos], state)
            at += rank[:, -1]
        return [out[k, : lens[k]] for k in range(n)]


def _pack(coder: Coder, part: int, segment: int, start: int, keys: list, ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids)
    blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
    words, states = coder.encode(blocks)
    return {
        "part": part,
        "segment": segment,
        "start": start,
        "doc_ids": np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
        "doc_null": np.array([k is None for k in keys], dtype=np.uint8).tobytes(),
        "doc_tokens": np.array([len(x) for x in ids], dtype="<i8").tobytes(),
        "n_ids": len(flat),
        "words": np.array([len(w) for w in words], dtype="<i8").tobytes(),
        "states": states.astype("<u8").tobytes(),
        "checks": np.array([zlib.crc32(b.astype("<u4").tobytes()) for b in blocks], dtype="<u4").tobytes(),
        "payload": np.concatenate(words).astype("<u4").tobytes(),
    }


def unpack(coder: Coder, row: dict) -> tuple[list, list[np.ndarray]]:
    """doc_ids and ids of a segment's documents; every block is held against its checksum."""
    words = np.split(np.frombuffer(row["payload"], "<u4"), np.cumsum(np.frombuffer(row["words"], "<i8"))[:-1])
    n = len(words)
    lens = np.full(n, BLOCK)
    lens[-1] = row["n_ids"] - BLOCK * (n - 1)
    blocks = coder.decode(words, np.frombuffer(row["states"], "<u8").reshape(n, LANES), lens)
    for block, check in zip(blocks, np.frombuffer(row["checks"], "<u4").tolist(), strict=True):
        if zlib.crc32(block.astype("<u4").tobytes()) != check:
            raise ValueError(f"segment {row['segment']} of part {row['part']}: a block doesn't match its checksum")
    flat = np.concatenate(blocks)
    cuts = np.cumsum(np.frombuffer(row["doc_tokens"], "<i8"))
    keys = [None if gone else k for k, gone in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["doc_null"], strict=True)]
    return keys, np.split(flat, cuts[:-1])


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every document, end id included, as little-endian 16- or 32-bit integers.

    The last row of a task has ``counts`` in place of a document: how often it has met each id.
    """

    def run(batches):
        tokens = piece_tokens(path)
        size = tokens.library.get_vocab_size()
        kind = "<u2" if size <= 1 << 16 else "<u4"
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices([len(t) for t in texts]):
                got = tokens.encode(texts[i:j])
                total += np.bincount(np.concatenate(got), minlength=size) if got else 0
                total[0] += len(got)
                ids = [x.astype(kind).tobytes() + b"\0" * int(kind[2]) for x in got]
                none = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary()), none, pa.array([False] * len(ids))], names=["doc_id", "ids", "counts", "is_count"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([True])], names=["doc_id", "ids", "counts", "is_count"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, ids binary, counts binary, is_count boolean")


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Corpus counts of all ids from the tasks' counts; the driver gets one number for each id that occurs."""

    def spread(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["id", "n"])

    rows = counts.select("counts").mapInArrow(spread, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_files(docs: DataFrame, path: str, folder: str) -> None:
    """Encode ``docs`` with the vocabulary file at ``path`` into ``folder``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(path).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    both = store(tokenised(docs, path), "token-ids", "is_count")
    ids = both.where("not is_count").select("doc_id", "ids")
    counts = frequencies(both.where("is_count"), size)
    freq = quantised(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq bigint").coalesce(1).write.parquet(f"{folder}/table")
    total = int(counts.sum()) * int(kind[2])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        from pyspark import TaskContext

        coder = Coder(shared.value)
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        keys, held, length = [], [], 0
        kinds = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("start", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "doc_null", "doc_tokens")], ("n_ids", pa.int64()), *[(c, pa.binary()) for c in ("words", "states", "checks", "payload")]])
        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(x, kind)
                if held and length + len(x) > SEGMENT:
                    yield pa.RecordBatch.from_pylist([_pack(coder, part, segment, start, keys, held)], kinds)
                    segment += 1
                    start += length
                    keys, held, length = [], [], 0
                keys.append(k)
                held.append(x)
                length += len(x)
        if held:
            yield pa.RecordBatch.from_pylist([_pack(coder, part, segment, start, keys, held)], kinds)

    ordered = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(f"{folder}/segments")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    freq = np.array([r.freq for r in spark.read.parquet(f"{folder}/table").orderBy("id").collect()])
    segments = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/segments")
    before, total = {}, 0
    for row in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[row.part] = total
        total += row.n
    shared = spark.sparkContext.broadcast((freq, before))

    def make():
        freq, before = shared.value
        coder = Coder(freq)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, starts, lens, crcs = [], [], [], []
            for row in batch.to_pylist():
                at = before[row["part"]] + row["start"]
                own, ids = unpack(coder, row)
                keys += own
                for x in ids:
                    starts.append(at)
                    lens.append(len(x))
                    crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                    at += len(x)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return work

    return map_batches(segments, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", make)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, folder)
    return read_files(docs.sparkSession, folder)
