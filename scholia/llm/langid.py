"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton holds a bounded sample of labelled text.  A whole
text is parsed against it greedily: each phrase is the longest match from there on.  A
phrase costs the bits that name it, log2 of the sample's size for its place and
2 log2(length + 1) for its length; a byte that the sample lacks costs LITERAL bits, more
than it takes to write it out.  So neither a tiny sample nor a large one wins by its
size.  The language with the fewest bits wins.

The texts of a batch are parsed in lock step with numpy, one lane each, from the first
byte to the last; when few long texts are left, a plain loop takes each to its end.  An automaton is a
displacement table: the edges of its states lie interleaved in one array of about 1.6
entries an edge.

Defined results: `und` with score 0 for null texts and texts without a letter, or when
nothing was learned; ties go to the first language by name; null and repeated ids
keep a row per input row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import crc_mod, materialise

FOLDS, HELD_OUT = 3, 1
#: the training sample of a language: so many distinct texts at most (by least digest), whole, until they
#: hold SAMPLE_BYTES; texts over LONG_BYTES are taken only where shorter ones are too few.
SAMPLE_DOCS, SAMPLE_BYTES, LONG_BYTES = 96, 100_000, 20_000
#: bits of a byte that the sample lacks.
LITERAL = 9.0
#: bytes parsed at a time, and lanes below which a plain loop is faster.
BATCH_BYTES, FEW_LANES = 32 << 20, 24
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


class SuffixAutomaton:
    """States with transitions (byte -> state); every path from state 0 spells a substring."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in data:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


def displaced(states: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, next): state s has an edge c where check[base[s] + c] == s, to next[base[s] + c].

    States with most edges are placed first, at random bases; those with one edge fill the holes.
    """
    edges = sum(map(len, states))
    size = int(edges * 1.6) + 1024
    base, check, to = np.zeros(len(states), np.int32), np.full(size + 512, -1, np.int32), np.zeros(size + 512, np.int32)
    used, rnd, hole = bytearray(size + 512), random.Random(1), 256
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        out = states[s]
        if not out:
            base[s] = size  # nothing lies there that is its own
            continue
        first, *rest = out
        while True:
            if rest:
                at = rnd.randrange(256, size)
                if used[at] or any(used[at - first + c] for c in rest):
                    continue
            else:
                while used[hole]:
                    hole += 1
                at = hole
            break
        base[s] = at - first
        for c, q in out.items():
            used[at - first + c], check[at - first + c], to[at - first + c] = 1, s, q
    return base, check, to


@dataclass
class Model:
    langs: list[str]
    base: np.ndarray  # of each state, the languages' states one after the other
    check: np.ndarray
    next: np.ndarray
    root: np.ndarray  # first state by language
    start: np.ndarray  # language, byte -> state after the byte from the root; the root itself if the sample lacks it
    place: np.ndarray  # bits of a phrase's place by language

    def phrases(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, bits) of each text by language."""
        count, bits = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BATCH_BYTES):
                size += len(texts[upto])
                upto += 1
            self._parse(texts[at:upto], count[at:upto], bits[at:upto])
            at = upto
        return count, bits

    def _parse(self, texts: list[bytes], count: np.ndarray, bits: np.ndarray) -> None:
        widths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-widths, kind="stable")  # lanes that have ended are last
        data = np.frombuffer(b"".join(texts), np.uint8)
        offset = (np.cumsum(widths) - widths)[order]
        widths = widths[order]
        k, n = len(self.langs), len(texts)
        # a lane is a text and a language; lanes lie by text
        state = np.tile(self.root, n).astype(np.int32)
        begun = np.zeros(n * k, np.int64)
        cost, made = np.zeros(n * k), np.zeros(n * k, np.int64)
        starts, roots, t = self.start.T.copy(), np.tile(self.root, n), 0
        while True:
            alive = int(np.searchsorted(-widths, -t, side="left"))  # texts with a byte at t
            if not alive or alive < FEW_LANES:
                break
            byte = data[offset[:alive] + t]
            m = alive * k
            slot = self.base[state[:m]] + np.repeat(byte, k)
            follows = self.check[slot] == state[:m]
            ends = np.flatnonzero(~follows)
            state[:m] = self.next[slot]
            if len(ends):
                size = t - begun[ends]
                some = size > 0
                cost[ends] += np.where(some, self.place[ends % k] + 2 * np.log2(size + 1), 0)
                fresh = starts[byte[ends // k], ends % k]
                lacks = fresh == roots[ends]
                cost[ends] += lacks * LITERAL
                made[ends] += some.astype(np.int64) + lacks
                state[ends] = fresh
                begun[ends] = np.where(lacks, t + 1, t)
            t += 1
        if alive:
            self._finish(data, offset[:alive], widths[:alive], t, state, begun, cost, made)
        size = np.repeat(widths, k) - begun
        cost += np.where(size > 0, np.tile(self.place, n) + 2 * np.log2(np.maximum(size, 0) + 1), 0)
        made += size > 0
        count[order], bits[order] = made.reshape(n, k), cost.reshape(n, k)

    def _finish(self, data, offset, widths, t, state, begun, cost, made) -> None:
        """Each text left, from place t on, by a plain loop."""
        base, check, to, k = memoryview(self.base), memoryview(self.check), memoryview(self.next), len(self.langs)
        for i in range(len(offset)):
            rest = data[offset[i] + t : offset[i] + widths[i]].tobytes()
            for j in range(k):
                lane, place, start, root = i * k + j, float(self.place[j]), self.start[j].tolist(), int(self.root[j])
                s, since, sizes, lacking = int(state[lane]), int(begun[lane]), [], 0
                for at, byte in enumerate(rest, t):
                    x = base[s] + byte
                    if check[x] == s:
                        s = to[x]
                        continue
                    if at > since:
                        sizes.append(at - since)
                    s, since = start[byte], at
                    if s == root:
                        lacking += 1
                        since = at + 1
                cost[lane] += lacking * LITERAL + len(sizes) * place + 2 * float(np.log2(np.array(sizes, float) + 1).sum())
                made[lane] += lacking + len(sizes)
                begun[lane] = since

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and _LETTER.search(t) is not None for t in texts]
        if not self.langs:
            known = [False] * len(texts)
        if any(known):
            _, costs = self.phrases([normalised(t) if k else b"" for t, k in zip(texts, known)])
        langs, scores = [], []
        for i, k in enumerate(known):
            if not k:
                langs.append("und")
                scores.append(0.0)
                continue
            bits = costs[i]
            best = int(np.argmin(bits))
            rest = np.delete(bits, best)
            langs.append(self.langs[best])
            scores.append(float(1 - bits[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
        return langs, scores


def build(samples: dict[str, bytes]) -> Model:
    langs = sorted(k for k, v in samples.items() if v)
    bases, checks, nexts, roots, starts, states, slots = [], [], [], [], [], 0, 0
    for lang in langs:
        edges = SuffixAutomaton(samples[lang]).next
        base, check, to = displaced(edges)
        bases.append(base + slots)
        checks.append(np.where(check >= 0, check + states, -1).astype(np.int32))
        nexts.append(to + states)
        roots.append(states)
        start = np.full(256, states, np.int32)
        for c, q in edges[0].items():
            start[c] = q + states
        starts.append(start)
        states += len(base)
        slots += len(check)
    whole = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
    place = np.array([np.log2(len(samples[k]) + 1) for k in langs])
    return Model(langs, whole(bases), whole(checks), whole(nexts), np.array(roots, np.int32), np.array(starts, np.int32), place)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the training folds.  Of each language at most SAMPLE_DOCS distinct texts are read, each whole,
    until they hold SAMPLE_BYTES (the first is read in any case)."""
    digest, size = F.sha2(F.col(text_col), 256), F.octet_length(F.col(text_col))
    rows = docs.where((crc_mod(id_col, FOLDS) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), digest.alias("digest"), size.alias("size")
    )
    # one row of each text, however many copies it has; digests choose at random
    known = rows.groupBy("lang", "digest").agg(F.first("size").alias("size"))
    order = (F.col("size") > LONG_BYTES, "digest")
    # in two steps, so that a language held by most rows does not meet in one task
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("digest"), F.lit(64))).orderBy(*order)
    best = known.withColumn("r", F.row_number().over(part)).where(F.col("r") <= SAMPLE_DOCS).drop("r")
    first = Window.partitionBy("lang").orderBy(*order)
    ranked = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_DOCS)
    before = F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, -1))
    chosen = materialise(ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("lang", "digest", "r"), "langid-sample")
    # SAMPLE_DOCS rows a language at most
    met = rows.join(F.broadcast(chosen), ["lang", "digest"]).select("lang", "r", "text").dropDuplicates(["lang", "r"])
    samples: dict[str, bytes] = {}
    for row in met.orderBy("lang", "r").collect():
        samples[row["lang"]] = samples.get(row["lang"], b"") + normalised(row["text"]) + b" "
    return build(samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row.  The model (a few MB a language, by SAMPLE_BYTES) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            langs, scores = shared.value.predict(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )
