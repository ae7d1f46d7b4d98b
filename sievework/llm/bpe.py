"""BPE encoding and decoding with a contiguous rank array per word.

A vocabulary in the tokenizers library's JSON format is applied as that library does: added tokens are
cut out of the raw text, the rest is normalised (NFC, white space, lower case), split into words, and
each word's bytes are merged. A word's parts and the merge ranks of neighbouring parts are two short
contiguous arrays: the minimum is found by scanning, one boundary is deleted, and the ranks beside it are
refreshed. Words of more than ``LONG`` bytes use the same merges with a heap, so that a text without
white space takes n log n steps.

White-space separated pieces are independent, so each task keeps a dictionary of the pieces it has
seen, emptied at ``CACHE`` entries or ``CACHE_CHARS`` characters and when the task ends. Decoding joins the token strings with a space, as the library does for
a vocabulary without a decoder.

Edge cases: null text counts as empty; empty or blank text has no tokens and decodes to the empty string;
the vocabulary's truncation and padding are unused; equal rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievework.llm.common import AT_TASK_END, UNICODE_SPACE, map_batches

LONG = 400
CACHE, CACHE_CHARS = 200_000, 20_000_000
_NONE = 1 << 62
_PIECES = re.compile(f"[^{UNICODE_SPACE}]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in own else more))
        more += b not in own
    return out


class WordCoder:
    """Encoder of one vocabulary file; word splitting, normalisers and added tokens come from the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.digits = {i: str(i) for i in self.token}
        self.ids: dict[str, str] = _Pieces(self)
        self.texts: dict[str, str] = {}
        self.seen: dict[str, list[int]] = {}
        self.held = 0
        self.marks = {t[0] for t in self.special}

    def forget(self) -> None:
        self.held = 0
        self.ids.clear()
        self.texts.clear()
        self.seen.clear()

    def word(self, word: str) -> list[int]:
        """Token ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        first = self.first
        parts = [first[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        return self._heap(parts) if len(parts) > LONG else self._scan(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.merge.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            new = parts[i] = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.merge.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 20 | parts[j], _NONE) != r:
                continue
            parts[i], parts[j] = r & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := get(parts[i] << 20 | parts[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := get(parts[h] << 20 | parts[i], _NONE)) != _NONE:
                heapq.heappush(heap, (s, h))
        return [p for p in parts if p >= 0]

    def piece(self, piece: str) -> list[int]:
        """Token ids of a normalised piece without white space."""
        out: list[int] = []
        for w in self.words.findall(piece):
            ids = self.seen.get(w)
            if ids is None:
                ids = self.seen[w] = self.word(w)
            out += ids
        return out

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() has a final form of sigma, the library hasn't
                text = text.replace("Σ", "σ")
        return text.lower()

    def joined(self, text: str) -> tuple[str, str]:
        """Ids and token strings of a text, each joined by a space."""
        if len(self.ids) > CACHE or self.held > CACHE_CHARS:
            self.forget()
        parts = self.cut.split(text) if self.cut and any(m in text for m in self.marks) else [text]
        ids, tokens = [], []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(str(self.special[part]))
                tokens.append(part)
            elif part:
                part = self.normalised(part)
                pieces = part.split() if not _CONTROLS.search(part) else _PIECES.findall(part)
                if pieces:
                    ids.append(" ".join(map(self.ids.__getitem__, pieces)))
                    tokens.append(" ".join(map(self.texts.__getitem__, pieces)))
        return " ".join(ids), " ".join(tokens)

    def encode(self, text: str | None) -> list[int]:
        joined = self.joined(text or "")[0]
        return [int(x) for x in joined.split(" ")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids if i in self.token])


class _Pieces(dict):
    """Piece to its ids as text; fills in both dictionaries of its coder."""

    def __init__(self, coder: WordCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> str:
        self.coder.held += len(piece)
        ids = self.coder.piece(piece)
        out = self[piece] = " ".join(map(self.coder.digits.__getitem__, ids))
        self.coder.texts[piece] = " ".join(map(self.coder.token.__getitem__, ids))
        return out


_CODERS: dict[str, WordCoder] = {}


def _forget() -> None:
    for c in _CODERS.values():
        c.forget()


AT_TASK_END.append(_forget)


def coder(path: str) -> WordCoder:
    """The worker's coder of a vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and decoded text of every document."""

    def make():
        code = coder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [code.joined(t or "") for t in batch.column("text").to_pylist()]
            ids = [[int(x) for x in a.split(" ")] if a else [] for a, _ in got]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([b for _, b in got], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, ids array<int>, decoded string", make)


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def make():
        code = coder(path)
        sha = hashlib.sha256

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids, tokens = code.joined(text or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(tokens.encode("utf-8", "surrogatepass")).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
