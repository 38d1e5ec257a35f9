"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes (its value depends on the last 32 bytes) ends a chunk
where it is the least within REACH bytes to either side, so borders depend on what stands
around them alone and move with the content when text is inserted before.  A piece at
either end of a text that is no longer than REACH goes with its neighbour, so a chunk is
longer than REACH unless the whole text is not: short lines that repeat make no chunk.
Chunks meet on a 128-bit digest; of equal chunks the first place (least id, then
first in the text) stays and all the others are removed.

Chunks are cut once and written; digests are counted with partial aggregates, which are
written too, and joined back by a join between two plain shuffles that Spark can split, so a
chunk that a third of all documents hold is no hot spot.

Defined results: null texts are empty and have no chunks; ids may be of any type that Spark orders;
places belong to a row key, 128 bits of a digest of id and text, so rows that share an id (or have none) are judged apart; of
equal rows one is judged and its result given once a row, the first with its first places and the
others as copies; null ids come before all others; a chunk that occurs once stays; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, row_key

#: bytes to either side within which a border's hash is the least.
REACH = 56
_RANDOM = random.Random(20_240_229)
GEAR = np.array([_RANDOM.getrandbits(32) for _ in range(256)], np.uint32)
#: bytes hashed at a time.
BLOCK = 1 << 20


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 32 of GEAR[data[i - j]] << j, modulo 2^32, by doubling the reach."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        older = h[:-reach] << np.uint32(reach)
        h = h.copy()
        h[reach:] += older
    return h


def _least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of h within `reach` places to either side, by minima from both ends of blocks of that width."""
    width = 2 * reach + 1
    ends = np.full(reach, np.iinfo(h.dtype).max, h.dtype)
    padded = np.concatenate([ends, h, ends, np.full(-(len(h) + 2 * reach) % width, ends[0], h.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, 1).ravel()
    return np.minimum(ahead[: len(h)], behind[width - 1 : width - 1 + len(h)])


def borders(data: bytes, reach: int = REACH) -> list[int]:
    """Where the gear hash is the least within `reach` bytes to either side; of equal ones that close the first."""
    raw, out = np.frombuffer(data, np.uint8), []
    for at in range(0, len(raw), BLOCK):
        begin = max(0, at - reach)
        warm = max(0, begin - 31)
        h = gear_hash(raw[warm : at + BLOCK + reach])[begin - warm :]
        least = np.flatnonzero(h == _least_around(h, reach)) + begin
        out.append(least[(least >= at) & (least < at + BLOCK)] + 1)
    cuts, last = [], -reach - 1
    for p in np.concatenate(out).tolist() if out else []:
        if p - last > reach:
            cuts.append(p)
            last = p
    return cuts


def cut_points(data: bytes, reach: int = REACH) -> list[int]:
    """Ends of the chunks of data, in order; the last is its length."""
    cuts = [p for p in borders(data, reach) if reach < p < len(data) - reach]
    return [*cuts, len(data)] if data else []


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chunk_table(texts: DataFrame) -> DataFrame:
    """doc_id, h (of the row), at, size, d1, d2 (halves of the digest), first (whether the text has it there first)."""

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                data = (b.column("text")[k].as_py() or "").encode()
                ends = cut_points(data)
                if not ends:
                    continue
                begins, seen, d1, d2, first = [0, *ends[:-1]], set(), [], [], []
                for x, y in zip(begins, ends):
                    d = xxhash.xxh3_128_intdigest(data[x:y])
                    first.append(d not in seen)
                    seen.add(d)
                    d1.append(_signed(d >> 64))
                    d2.append(_signed(d & 0xFFFFFFFFFFFFFFFF))
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.repeat(b.column(c)[k], n) for c in ("doc_id", "h")], pa.array(begins, pa.int32()),
                        pa.array([y - x for x, y in zip(begins, ends)], pa.int32()),
                        pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(first, pa.bool_()),
                    ],
                    names=["doc_id", "h", "at", "size", "d1", "d2", "first"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "h", "text").mapInArrow(
        run, f"doc_id {kind}, h binary, at int, size int, d1 long, d2 long, first boolean"
    )


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """h, at, size, removed for each place of a chunk that occurs more than once."""
    chunks = materialise(chunk_table(texts), "cdc-chunks")
    row = F.struct("doc_id", "h")
    shared = materialise(chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("owner")).where("n > 1"), "cdc-shared")
    met = chunks.join(shared, ["d1", "d2"])
    # h takes in the id, so it is the row's own
    return met.select("h", "at", "size", (~(F.col("first") & (F.col("h") == F.col("owner.h")))).alias("removed"))


def removed_runs(lost: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of neighbouring (at, size)."""
    runs: list[list[int]] = []
    for at, size in lost:
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return [(x, y) for x, y in runs]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_shared (bytes in chunks that occur elsewhere too), n_removed, n_spans, kept (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.withColumn("h", row_key("doc_id", "text"))
    places = repeated_chunks(texts).groupBy("h").agg(F.collect_set(F.struct("at", "size", "removed")).alias("places"))
    # equal rows are one row with their number; the text moves once, for this and for the join
    held = texts.groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    met = held.join(places, "h", "left").select("doc_id", "copies", "text", "places")

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for k in range(len(b)):
                data = (b.column("text")[k].as_py() or "").encode()
                places = sorted(b.column("places")[k].as_py() or [], key=lambda x: x["at"])
                shared, kept, upto = sum(p["size"] for p in places), [], 0
                spans = removed_runs([(p["at"], p["size"]) for p in places if p["removed"]])
                for x, y in spans:
                    kept.append(data[upto:x])
                    upto = y
                kept.append(data[upto:])
                rest = b"".join(kept)
                for c, x in zip(cols, (len(data), shared, len(data) - len(rest), len(spans), rest)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("copies"), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())],
                names=["doc_id", "copies", "n_bytes", "n_shared", "n_removed", "n_spans", "kept"],
            )

    out = met.mapInArrow(run, f"doc_id {kind}, copies long, n_bytes long, n_shared long, n_removed long, n_spans long, kept binary")
    # a row's further copies lose all their bytes
    other = F.col("k") > 1
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", "n_bytes",
        *[F.when(other, F.col("n_bytes")).otherwise(F.col(c)).alias(c) for c in ("n_shared", "n_removed")],
        F.when(other, (F.col("n_bytes") > 0).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(other, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
