"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash and displace) resolves
whole pre-tokens; the bytes at the slot are compared, so a foreign pre-token is a
miss.  Tier 2: misses are merged by a heap over linked bytes, lowest rank first,
leftmost among equals.  Every distinct pre-token of a task goes through the tiers
once; a bounded memo keeps its ids.

Defined results: a null text counts as empty (no ids); null and repeated ids keep a
row per input row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: pre-tokens of a generation of a worker's memo; it has two.
MEMO = 120_000
#: characters of text whose ids are held before they are handed on.
HELD_CHARS = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file: bytes by id."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[k] for k in range(len(ranks))]


def _digests(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def _place(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d.astype(np.uint64) * _M1)) * _M2
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct keys to a slot of its own in 0..n-1."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        h = _digests(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine = order[begins[b] : begins[b + 1]]
            first = 0
            while True:  # a block of displacements at a time
                tried = np.arange(first, first + 64)
                slots = _place(np.repeat(h[mine][None, :], 64, 0), np.repeat(tried[:, None], len(mine), 1), n)
                free = (self.slot_key[slots] < 0).all(1)
                ordered = np.sort(slots, 1)
                free &= (np.diff(ordered, axis=1) > 0).all(1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b] = tried[k]
                    self.slot_key[slots[k]] = mine
                    break
                first += 64
        open_slots = iter(np.flatnonzero(self.slot_key < 0).tolist())
        for b in np.flatnonzero(sizes == 1):  # a lone key names its slot outright, as -1 - slot
            slot = next(open_slots)
            self.shift[b] = -1 - slot
            self.slot_key[slot] = order[begins[b]]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The key number at each key's slot; the caller compares the keys."""
        h = _digests(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_key[np.where(d < 0, -1 - d, _place(h, np.maximum(d, 0), self.n))]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.index = PerfectHash(tokens)
        self._prepare()

    def _prepare(self) -> None:
        rank = {t: k for k, t in enumerate(self.tokens)}
        self.byte_id = [rank.get(bytes([b]), -1) for b in range(256)]
        self.two = {t: k for t, k in rank.items() if len(t) == 2}
        #: (left id, right id) -> id of the two joined, for all that the vocabulary has
        self.wide = len(self.tokens).bit_length()
        self.pair = {
            x << self.wide | y: k
            for t, k in rank.items()
            for i in range(1, len(t))
            if (x := rank.get(t[:i])) is not None and (y := rank.get(t[i:])) is not None
        }
        self.find_all = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "index": self.index}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._prepare()

    def split(self, text: str) -> list[str]:
        return self.find_all(text)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by merging: a heap of pairs (rank, place) over doubly linked parts."""
        end, wide, joined = len(piece), self.wide, self.pair.get
        shift = 12 if end < 4096 else 40  # small numbers are faster
        places = (1 << shift) - 1
        two = self.two.get
        heap = [r << shift | k for k in range(end - 1) if (r := two(piece[k : k + 2])) is not None]
        heapify(heap)
        part = [self.byte_id[b] for b in piece]
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            x = heappop(heap)
            k, r = x & places, x >> shift
            left, j = part[k], after[k]
            if left < 0 or j >= end or joined(left << wide | part[j]) != r:
                continue  # one of the two has been merged since
            part[k], part[j] = r, -1
            after[k] = j = after[j]
            if j < end:
                before[j] = k
                if (m := joined(r << wide | part[j])) is not None:
                    heappush(heap, m << shift | k)
            if (i := before[k]) >= 0 and (m := joined(part[i] << wide | r)) is not None:
                heappush(heap, m << shift | i)
        return tuple([p for p in part if p >= 0])

    def _resolve(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        tokens, memo, merge = self.tokens, self.memo, self.merge
        for p, b, k in zip(pieces, raw, self.index.find(raw).tolist()):
            memo[p] = (k,) if tokens[k] == b else merge(b)

    def encode(self, text: str) -> np.ndarray:
        pieces = self.split(text)
        if len(self.memo) > MEMO:  # two generations: what is still in use is carried over
            self.memo, self.older = {}, self.memo
        memo, older, fresh = self.memo, self.older, []
        for p in set(pieces).difference(memo):
            if (known := older.get(p)) is not None:
                memo[p] = known
            else:
                fresh.append(p)
        if fresh:
            self._resolve(fresh)
        return np.array(list(chain.from_iterable(map(memo.__getitem__, pieces))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    The vocabulary and its hash (about 2 MB, whatever the input) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(read_ranks(path), pattern))

    def encode(batches):
        encoder = shared.value
        for batch in batches:
            begin, texts, size = 0, [], 0
            for k in range(len(batch)):
                texts.append(batch.column("text")[k].as_py() or "")
                size += len(texts[-1])
                if size >= HELD_CHARS or k + 1 == len(batch):
                    yield coded(encoder, batch.column("doc_id").slice(begin, len(texts)), texts)
                    begin, texts, size = k + 1, [], 0

    def coded(encoder, doc_ids, texts):
        ids = [encoder.encode(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                doc_ids, pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary()),
            ],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        encode, f"doc_id {kind}, n_tokens long, ids binary, decoded binary"
    )
