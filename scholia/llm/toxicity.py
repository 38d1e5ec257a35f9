"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Positives are documents marked toxic; everything else is unlabelled, since an
unmarked document may be toxic too.  With class prior p the risk is
    p * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)]),
and where the bracket is negative the step goes up its gradient instead.
The model is linear over the presence of words; words are chosen by how far their
share among the positives exceeds their share among the unlabelled.

Training reads a bounded sample (SAMPLE_POSITIVE, SAMPLE_UNLABELLED documents, those
with the least hash of their id); scoring reads every whole text.  Labels come
only from rows outside the held-out fold.

Defined results: a text without words, null included, gets the model's bias; with no
positives at all every score is the prior; null and repeated ids keep a row per
input row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scholia.llm.common import crc_mod, materialise

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 4_000, 16_000
#: hashed word space, and the words a model may use.
DIM, FEATURES = 1 << 20, 512
FOLDS = 5
_WORD = regex.compile(r"\p{L}+")


def hashed_words(text: str | None) -> list[int]:
    """Distinct words of a text, lower-cased, as numbers below DIM."""
    return sorted({zlib.crc32(w.encode()) % DIM for w in set(_WORD.findall((text or "").lower()))})


@dataclass
class Model:
    words: dict[int, float]
    bias: float

    def score(self, found: list[int]) -> float:
        z = self.bias + sum(self.words.get(w, 0.0) for w in found)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def choose_words(pos: list[np.ndarray], unl: list[np.ndarray], limit: int = FEATURES) -> np.ndarray:
    """Words whose share among positives exceeds that among unlabelled by the largest z, at least 4."""
    n, m = len(pos), len(unl)
    a = np.bincount(np.concatenate(pos), minlength=DIM).astype(float)
    b = np.bincount(np.concatenate(unl), minlength=DIM).astype(float) if m else np.zeros(DIM)
    share = (a + b + 1) / (n + m + 2)
    z = (a / n - b / max(m, 1)) / np.sqrt(share * (1 - share) * (1 / n + 1 / max(m, 1)))
    z[a < 3] = 0
    best = np.argsort(-z, kind="stable")[:limit]
    return np.sort(best[z[best] >= 4])


def matrix(docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """A row of zeros and ones per document: the words, then a one for the bias."""
    x = np.zeros((len(docs), len(words) + 1), np.float32)
    x[:, -1] = 1
    for k, d in enumerate(docs):
        x[k, np.searchsorted(words, np.intersect1d(d, words, assume_unique=True))] = 1
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk; where its bracket is negative, of the bracket, upwards.  Only vectors change type, so that no matrix is copied."""
    sp, su = (sigmoid((x @ w.astype(x.dtype)).astype(float)) for x in (xp, xu))
    as_negative = np.mean(-np.log(1 - np.clip(su, 0, 1 - 1e-9))) - prior * np.mean(-np.log(1 - np.clip(sp, 0, 1 - 1e-9)))
    g_neg = xu.T @ su.astype(xu.dtype) / len(xu) - prior * (xp.T @ sp.astype(xp.dtype)) / len(xp)
    return prior * (xp.T @ (sp - 1).astype(xp.dtype)) / len(xp) + g_neg if as_negative >= 0 else -g_neg


def train_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4):
    """Weights and bias of a linear model under the non-negative risk with the logistic loss (Adam).

    The last column of xp and xu is the bias's, all ones."""
    w = np.zeros(xp.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w, xp, xu, prior)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> Model:
    prior = float(np.clip(prior, 1e-3, 0.49))  # without evidence a text is not toxic
    bias = float(np.log(prior / (1 - prior)))
    if not pos or not any(len(p) for p in pos):
        return Model({}, bias)
    words = choose_words(pos, unl)
    if not len(words) or not unl:
        return Model({}, bias)
    w, bias = train_nnpu(matrix(pos, words), matrix(unl, words), prior)
    return Model(dict(zip(words.tolist(), w.tolist())), bias)


def _featurise(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> dict[str, list[np.ndarray]]:
    """Word numbers of the sampled documents; chosen has at most the sampled ids, so it is broadcast."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "kind", "text")

    def run(batches):
        for b in batches:
            found = [np.asarray(hashed_words(t.as_py()), np.int32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind"), pa.array(found, pa.binary())], names=["id", "kind", "words"])

    told = picked.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, kind string, words binary")
    told = told.groupBy("id", "kind").agg(F.min("words").alias("words")).select("kind", "words")  # one row of an id that repeats
    out: dict[str, list[np.ndarray]] = {"p": [], "u": []}
    for kind, words in sorted((r["kind"], bytes(r["words"])) for r in told.collect()):  # within the sample bounds, the same order in each run
        out[kind].append(np.frombuffer(words, np.int32))
    return out


def _least(ids: DataFrame, most: int) -> DataFrame:
    """The `most` ids with the least hashes.  The rows are counted first, and only those under a hash that about twice as many
    are under are sorted, so that what meets in one task does not grow with the number of partitions."""
    h, n = F.xxhash64("id"), ids.count()
    if n > 2 * most:
        near = ids.where(h < F.lit(int(-(2**63) + 2 * most / n * 2**64)))
        if near.count() >= most:  # always, but for ids that repeat without measure
            ids = near
    return ids.orderBy(h, "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the training folds.  The prior is the share of toxic among the labelled rows there."""
    known = labels.where(crc_mod(id_col, FOLDS) != 0).select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    prior = known.where("toxic IS NOT NULL").agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    positive = _least(known.where("toxic = 1").select("id").distinct(), SAMPLE_POSITIVE).withColumn("kind", F.lit("p"))
    pool = docs.where(crc_mod(id_col, FOLDS) != 0).select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    unlabelled = _least(pool, SAMPLE_UNLABELLED).distinct().withColumn("kind", F.lit("u"))
    sample = _featurise(docs, materialise(positive.unionByName(unlabelled), "toxicity-sample"), id_col, text_col)
    return fit(sample["p"], sample["u"], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Every column of docs with the score (double, 0 to 1), in place of any column of that name."""
    docs = docs.drop(name)

    def run(batches):
        for b in batches:
            scores = pa.array([model.score(hashed_words(t.as_py())) for t in b.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below 0.5."""
    model = train(docs, labels)
    return score(docs, model, name="__score").where("__score < 0.5").drop("__score")
