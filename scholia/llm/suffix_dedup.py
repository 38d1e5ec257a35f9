"""Removal of repeated byte strings by column-wise construction of a collection's
suffix order, its Burrows-Wheeler symbols and its common prefixes.

A string of `width` bytes that starts at more than one place is repeated; every byte
that such a string covers goes.  One sorted order over all suffixes of a corpus can't be
built in one task, so the strings are first dealt out so that equal ones meet:

1. Anchors.  Each window of `width` bytes has an anchor: its k-byte substring with the
   least hash, the leftmost of equals.  Equal windows have equal anchors at the same
   offset.  Neighbouring windows with one anchor form a segment.
2. Counting.  Anchors that occur once have no repeated window.  Where all segments of an
   anchor are equal, all their windows are repeated.  Both are settled by one aggregate
   over pairs of longs.  Only anchors with different segments go on, and each different
   segment once, with its count.
3. Columns.  Such a segment is cut into ranges of RANGE window starts.  All windows of a
   range share a core of width - RANGE + 1 bytes, which its digest stands for, so a row
   carries the core's digest and the few bytes on either side.  Rows with equal cores
   are aligned on it; their suffixes are built column by column from the right, one
   symbol of each row a round: a stable sort by symbol of the order so far, with the
   common prefix of neighbours one more than the least between them.  A window is
   repeated if its suffix shares RANGE symbols (the core counting as one) with a
   neighbour.  The columns of a task come from Spark's sorted shuffle files, in blocks.
   The rows of a core that more than HOT rows share are cut into half ranges with longer
   cores, until they part.
4. The repeated windows are joined back to all places of their segments, gathered by
   document, and cut from the text.

Defined results: null texts are empty; matches never cross rows; rows that repeat an id
and a text are places of their own and each keeps its result row; null ids keep their
rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, text_or_empty

WIDTH, ANCHOR = 200, 64
#: window starts of a range (a mask of them fits a long), and rows of a core from which they are cut finer.
RANGE, HOT = 46, 20_000
#: bytes of a text that are worked on at a time, and rows that are built into columns at a time.
BLOCK, ROWS = 1 << 20, 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_arrays(n: int):
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        up, down = np.full(n, _B, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte substring: differences of prefix sums of bytes times powers, mixed."""
    up, down = _power_arrays(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    n = len(raw) - k + 1
    return _mix((sums[k:] - sums[:n]) * down[:n])


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    reach = 1
    while reach * 2 <= n:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return h if reach == n else np.minimum(h[: len(h) - (n - reach)], h[n - reach :])


def segments(raw: np.ndarray, width: int = WIDTH, k: int = ANCHOR):
    """(first window, last window, anchor place, anchor hash) arrays of the segments of a text."""
    found = [_segments(raw[at : at + BLOCK + width - 1], width, k, at) for at in range(0, max(len(raw) - width + 1, 0), BLOCK)]
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*found)))


def _segments(raw: np.ndarray, width: int, k: int, shift: int):
    h, span = rolling(raw, k), width - k + 1
    m = least(h, span)
    begins = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    ends = np.concatenate([begins[1:] - 1, [len(m) - 1]])
    # the anchor of a run's first window; a run that goes on past it has further equal ones
    anchor = np.empty(len(begins), np.int64)
    for at in range(0, len(begins), 4096):
        b = begins[at : at + 4096]
        anchor[at : at + 4096] = b + np.argmin(h[b[:, None] + np.arange(span)], 1)
    over = np.flatnonzero(ends > anchor)
    if len(over):
        more = []
        for r in over.tolist():
            places = begins[r] + np.flatnonzero(h[begins[r] : ends[r] + span] == m[begins[r]])
            firsts = np.concatenate([[begins[r]], places[:-1] + 1])
            n = int(np.searchsorted(firsts, ends[r], side="right"))
            more.append((firsts[:n], np.minimum(places[:n], ends[r]), places[:n]))
        keep = np.ones(len(begins), bool)
        keep[over] = False
        begins, ends, anchor = (
            np.concatenate([x[keep], *[y[i] for y in more]]) for i, x in enumerate((begins, ends, anchor))
        )
    return begins + shift, ends + shift, anchor + shift, h[anchor]


def segment_table(texts: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """id, h (the row), t0, t1 (window starts), p (anchor place), a (anchor hash), s (digest of the segment)."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                data = b.column("text")[i].as_py().encode()
                t0, t1, p, a = segments(np.frombuffer(data, np.uint8), width, k)
                if not len(t0):
                    continue
                s = np.fromiter((xxhash.xxh3_64_intdigest(data[x : y + width]) for x, y in zip(t0.tolist(), t1.tolist())), np.uint64, len(t0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(b.column("id")[i], len(t0)), pa.repeat(b.column("h")[i], len(t0)), *[pa.array(x.astype(np.int32)) for x in (t0, t1, p)],
                        pa.array(a.view(np.int64)), pa.array(s.view(np.int64)),
                    ],
                    names=["id", "h", "t0", "t1", "p", "a", "s"],
                )

    return texts.select("id", "h", "text").mapInArrow(run, "id long, h long, t0 int, t1 int, p int, a long, s long")


ROW_SCHEMA = "key binary, core binary, left binary, right binary"


def _digest(*parts: bytes, salt: bytes = b"") -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, salt=salt).digest()


def _key(core: bytes, left: bytes, right: bytes) -> bytes:
    """Stands for all that a row holds."""
    return _digest(core, len(left).to_bytes(2, "little"), left, right)


def range_rows(picked: DataFrame, step: int, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """a, s, u (first start of the range, relative to the anchor), key, core (digest), left, right
    (bytes next to the core), for the segments in picked.segs (t0, t1, p, a, s) of picked.text."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("a", "s", "u", "key", "core", "left", "right")}
            for i in range(len(b)):
                data = b.column("text")[i].as_py().encode()
                for g in b.column("segs")[i].as_py():
                    p, t0, t1 = g["p"], g["t0"], g["t1"]
                    for u in range(k - width, 1, step):
                        v = u + step - 1  # the range's last start
                        if p + u > t1 or p + v < t0:
                            continue
                        core = _digest(data[p + v : p + u + width], salt=str(u).encode())
                        left, right = data[max(t0, p + u) : p + v], data[p + u + width : min(t1, p + v) + width]
                        for c, x in zip(out, (g["a"], g["s"], u, _key(core, left, right), core, left, right)):
                            out[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["a"], pa.int64()), pa.array(out["s"], pa.int64()), pa.array(out["u"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("key", "core", "left", "right")]],
                names=list(out),
            )

    return picked.select("text", "segs").mapInArrow(run, f"a long, s long, u int, {ROW_SCHEMA}")


def between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] for each pair, by a sparse table."""
    levels = [values]
    top = int(np.max(hi - lo + 1)).bit_length() - 1
    for j in range(top):
        levels.append(np.minimum(levels[-1][: -(1 << j)], levels[-1][1 << j :]))
    j = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for x in np.unique(j).tolist():
        at = j == x
        out[at] = np.minimum(levels[x][lo[at]], levels[x][hi[at] - (1 << x) + 1])
    return out


class Columns:
    """Suffixes of rows (by group) in order, with the common prefix of each and the one before."""

    def __init__(self, group: np.ndarray):
        self.group = group
        self.order = np.argsort(group, kind="stable")
        self.lcp = np.zeros(len(group), np.int32)

    def insert(self, symbol: np.ndarray) -> np.ndarray:
        """Put a symbol before every row's suffix; a symbol below 0 equals no other.  The
        symbols in the order so far, which this returns, are the round's BWT column."""
        bwt = symbol[self.order]
        at = np.lexsort((bwt, self.group[self.order]))  # stable: the order so far breaks ties
        same = np.zeros(len(at), bool)
        g, c = self.group[self.order[at]], bwt[at]
        same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (c[1:] >= 0)
        lcp = np.zeros(len(at), np.int32)
        k = np.flatnonzero(same)
        if len(k):
            lcp[k] = 1 + between(self.lcp, at[k - 1] + 1, at[k])
        self.order, self.lcp = self.order[at], lcp
        return bwt

    def sharing(self, least_common: int) -> np.ndarray:
        """Whether each row's suffix has so much in common with a neighbour's."""
        near = self.lcp >= least_common
        near[:-1] |= near[1:]
        out = np.empty(len(near), bool)
        out[self.order] = near
        return out


def shared_windows(group: np.ndarray, left: list[bytes], right: list[bytes], step: int) -> np.ndarray:
    """For rows aligned on their core: a mask by row; bit j: the window that starts j bytes
    before the core's first (j in 0..step-1) is another row's too."""
    n, side = len(group), step - 1
    l, r = np.full((n, side), -1, np.int16), np.full((n, side), -1, np.int16)
    for i in range(n):
        if left[i]:
            l[i, side - len(left[i]) :] = np.frombuffer(left[i], np.uint8)
        if right[i]:
            r[i, : len(right[i])] = np.frombuffer(right[i], np.uint8)
    columns, mask = Columns(group), np.zeros(n, np.int64)
    for k in range(side - 1, -1, -1):
        columns.insert(r[:, k])
    columns.insert(np.zeros(n, np.int16))  # the core
    mask |= columns.sharing(step).astype(np.int64)
    for j in range(1, step):
        columns.insert(l[:, side - j])
        mask |= columns.sharing(step).astype(np.int64) << j
    return mask


def build_columns(rows: DataFrame, step: int) -> DataFrame:
    """key, mask for rows (key, core, left, right) that lie sorted by core."""

    def flush(part: pa.Table) -> pa.RecordBatch:
        core = part.column("core").to_pylist()
        group = np.cumsum([0, *[x != y for x, y in zip(core, core[1:])]])
        some = np.bincount(group)[group] > 1  # a core alone shares nothing
        part, group = part.filter(pa.array(some)), group[some]
        mask = shared_windows(group, part.column("left").to_pylist(), part.column("right").to_pylist(), step)
        return pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(mask, pa.int64())], names=["key", "mask"])

    def run(batches):
        held, count = [], 0
        for b in batches:
            held.append(pa.table(b))
            count += len(b)
            if count < ROWS:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            core = whole.column("core").to_pylist()
            cut = len(core)  # the last core may go on in the next batch
            while cut and core[cut - 1] == core[-1]:
                cut -= 1
            if cut:
                yield flush(whole.slice(0, cut))
            held, count = [whole.slice(cut)], len(core) - cut
        if count:
            yield flush(pa.concat_tables(held).combine_chunks())

    return rows.select("key", "core", "left", "right").mapInArrow(run, "key binary, mask long")


def halved(rows: DataFrame, step: int) -> DataFrame:
    """Rows of ranges of `step` starts as rows of the first and the last `half` of them, each with a longer
    core: parent (their key), by (starts left out before), key, core, left, right.  A half that the
    row has no window of is left out."""
    half = (step + 1) // 2
    rest = step - half

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("parent", "by", "key", "core", "left", "right")}
            for r in b.to_pylist():
                left, core, right = r["left"], r["core"], r["right"]
                made = []
                if len(left) >= rest:
                    at = len(left) - rest
                    made.append((0, _digest(left[at:], core, salt=b"l" + bytes([step])), left[:at], right[: half - 1]))
                if len(right) >= rest:
                    made.append((rest, _digest(core, right[:rest], salt=b"r" + bytes([step])), left[max(0, len(left) - half + 1) :], right[rest:]))
                for by, c, x, y in made:
                    for name, value in zip(out, (r["key"], by, _key(c, x, y), c, x, y)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["parent"], pa.binary()), pa.array(out["by"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("key", "core", "left", "right")]],
                names=list(out),
            )

    return rows.select("key", "core", "left", "right").mapInArrow(run, f"parent binary, by int, {ROW_SCHEMA}")


def masks_of(rows: DataFrame, step: int, hot: int) -> DataFrame:
    """key, by, step, mask: the windows of each row that another row has too; window j of a mask starts
    by + step - 1 - j after the row's first start.

    Equal rows collapse first; all windows of one that occurs twice are shared.  Cores of up
    to `hot` different rows are built into columns.  The rows of other cores are halved, again and
    again: most part from each other at once, since a longer core takes in where they differ.
    """
    held = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.first("core").alias("core"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    held = materialise(held, "sa-contents")
    whole = held.where("n > 1").select(
        "key", F.lit(0).alias("by"), F.lit(step).alias("step"),
        F.expr(f"shiftleft(1L, length(left) + 1) - shiftleft(1L, greatest({step - 1} - length(right), 0))").alias("mask"),
    )
    if step == 1:
        return whole
    crowded = materialise(held.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("core"), "sa-crowded")
    few = held.join(crowded, "core", "left_anti").repartition("core").sortWithinPartitions("core")
    built = build_columns(few, step).where("mask != 0").select("key", F.lit(0).alias("by"), F.lit(step).alias("step"), "mask")
    out = whole.unionByName(built)
    if crowded.isEmpty():
        return out
    parts = materialise(halved(held.join(crowded, "core", "left_semi"), step), "sa-halves")
    found = materialise(masks_of(parts.select("key", "core", "left", "right"), (step + 1) // 2, hot).withColumnRenamed("by", "more"), "sa-masks")
    return out.unionByName(
        parts.select("parent", "by", "key").join(found, "key").select(F.col("parent").alias("key"), (F.col("by") + F.col("more")).alias("by"), "step", "mask")
    )


def repeated(texts: DataFrame, width: int = WIDTH, k: int = ANCHOR, hot: int = HOT, step: int = RANGE) -> DataFrame:
    """id, h, from, to, p, u, step, mask: where mask is null, all windows that start in [from, to)
    are repeated; else those at p + u + step - 1 - j for the bits j of the mask."""
    places = segment_table(texts, width, k)
    anchors = materialise(
        places.groupBy("a").agg(F.count(F.lit(1)).alias("c"), (F.min("s") != F.max("s")).alias("mixed")).where("c > 1").select("a", "mixed"),
        "sa-anchors",
    )
    found = materialise(places.join(anchors, "a"), "sa-places")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("p", "int"), ("u", "int"), ("step", "int"), ("mask", "long"))]
    ends = [F.col("t0").alias("from"), (F.col("t1") + 1).alias("to")]
    plain = found.where("NOT mixed").select("id", "h", *ends, *none)

    mixed = found.where("mixed")
    kinds = materialise(
        mixed.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "t0", "t1", "p")).alias("at")), "sa-kinds"
    )
    by_row = kinds.groupBy("at.id", "at.h").agg(F.collect_list(F.struct("at.t0", "at.t1", "at.p", "a", "s")).alias("segs"))
    rows = materialise(range_rows(texts.join(by_row, ["id", "h"]), step, width, k), "sa-rows")
    masks = materialise(masks_of(rows.select("key", "core", "left", "right"), step, hot), "sa-masks")
    # a segment that occurs more than once is repeated whole
    known = materialise(
        kinds.where("n > 1").select("a", "s", F.lit(None).cast("int").alias("u"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("long").alias("mask"))
        .unionByName(rows.select("a", "s", "u", "key").join(masks, "key").select("a", "s", (F.col("u") + F.col("by")).alias("u"), "step", "mask")),
        "sa-known",
    )
    return plain.unionByName(mixed.join(known, ["a", "s"]).select("id", "h", *ends, "p", "u", "step", "mask"))


def removed_runs(spans: pa.ListArray, width: int):
    """(owner, start, end) arrays of the maximal runs of bytes that the spans of each list cover, in order."""
    owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    got = {c: flat.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in enumerate(("from", "to", "p", "u", "step", "mask"))}
    masked = got["step"] > 0
    starts, ends, owners = [got["from"][~masked]], [got["to"][~masked] + width - 1], [owner[~masked]]
    if masked.any():
        m = {c: v[masked] for c, v in got.items()}
        bits = (m["mask"][:, None] >> np.arange(int(m["step"].max()))) & 1
        row, j = np.nonzero(bits)
        at = m["p"][row] + m["u"][row] + m["step"][row] - 1 - j
        starts, ends, owners = [*starts, at], [*ends, at + width], [*owners, owner[masked][row]]
    start, end, owner = map(np.concatenate, (starts, ends, owners))
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    if not len(start):
        return owner, start, end
    reach = np.maximum.accumulate(end + (owner << 40))  # lists do not meet
    first = np.ones(len(start), bool)
    first[1:] = start[1:] + (owner[1:] << 40) > reach[:-1]
    last = np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)
    return owner[first], start[first], reach[last] - (owner[last] << 40)


def deduplicate(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, hot: int = HOT, step: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumns(
        {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "h": F.xxhash64("text")}
    )
    spans = repeated(texts, width, k, hot, step).groupBy("id", "h").agg(
        F.collect_list(F.struct("from", "to", "p", "u", "step", "mask")).alias("spans")
    )

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            owner, start, end = removed_runs(b.column("spans"), width)
            edges = np.searchsorted(owner, np.arange(len(b) + 1))
            for i in range(len(b)):
                data, kept, upto = b.column("text")[i].as_py().encode(), [], 0
                x0, x1 = start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist()
                for x, y in zip(x0, x1):
                    kept.append(data[upto:x])
                    upto = y
                kept.append(data[upto:])
                rest = b"".join(kept)
                for c, x in zip(cols, (len(data), len(data) - len(rest), len(x0), rest)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return texts.join(spans, ["id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
