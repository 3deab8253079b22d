"""Quality classifier by positive-unlabelled learning.

The model is linear over features of the whole text: its shape (letter case, digits, marks, repeated words and lines, sizes) and its content (shares of
words by hash). It is fitted on trusted positives P and unlabelled text U by the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss: where the difference goes below zero, the step climbs it back instead. Negative labels are never read. The prior is the
share of positives in U, estimated from P and U alone: U is a mixture that holds P's distribution, so for every set of texts the prior is at most the
set's share in U over its share in P, and where the set is best chosen it is that. Sets are the texts that a linear separation of P from
U, fitted on the other half of the sample, puts above a threshold. P and U are bounded
samples (``SAMPLE`` rows each, chosen by a hash of the id, so they are the same on every run); scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Rows of each sample that the model is fitted on; buckets of words by hash.
SAMPLE, WORDS = 8000, 64
#: Byte classes counted in the UTF-8 text.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other": range(128, 256), "space": (32,), "line": (10,), "stop": b".,;:",
    "bang": b"!?", "quote": b"\"'`", "bracket": b"()[]{}<>", "mark": b"#$%&*@^~", "bar": b"|\\/_-+=",
}
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes)] = _i


def features(text: str | None) -> np.ndarray:
    """Shape and content features of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8")
    size = max(1, len(raw))
    by_class = np.bincount(_OF_BYTE, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES) + 1) / size
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    distinct, lengths = len(set(words)), len(raw) / n
    shouted = sum(map(bytes.isupper, words)) / n
    more = (np.log1p(len(words)), distinct / n, min(lengths, 50.0), shouted, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(words) / len(lines)))
    content = np.bincount([crc32(w) % WORDS for w in raw.lower().split()], minlength=WORDS) / n if words else np.zeros(WORDS)
    return np.concatenate([by_class, np.sqrt(by_class), more, np.sqrt(content)]).astype(np.float64)


@dataclass
class QualityModel:
    """Weights over standardised features; ``score`` is a probability of good quality."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.5, decay: float = 1e-4, unbiased: bool = True) -> QualityModel:
    """Minimise the non-negative risk by full-batch gradient steps with momentum; not ``unbiased``: the plain risk of telling the two samples apart."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    n, m = len(positive), len(unlabelled)
    x = np.clip((np.concatenate([positive, unlabelled]) - mean) / scale, -8, 8)
    x = np.c_[x, np.ones(n + m)].astype(np.float32)
    w, speed, coefficient = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.empty(n + m)
    for _ in range(steps):
        f = np.einsum("ij,j->i", x, w.astype(np.float32)).astype(np.float64)  # plain loops: threads of a matrix library would only wait
        up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        risk = np.logaddexp(0, f[n:]).mean() - prior * np.logaddexp(0, f[:n]).mean()
        if risk >= 0 or not unbiased:
            coefficient[:n] = prior / n * (up[:n] - 1 - (up[:n] if unbiased else 0))
            coefficient[n:] = up[n:] / m
        else:  # below zero the risk of negatives has been overfitted: undo that and nothing else
            coefficient[:n] = prior / n * up[:n]
            coefficient[n:] = -up[n:] / m
        grad = np.einsum("i,ij->j", coefficient.astype(np.float32), x).astype(np.float64) + decay * w
        speed = 0.9 * speed - 0.1 * rate * grad
        w = w + speed
    return QualityModel(mean, scale, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives in ``unlabelled``, from the two samples alone; sets hold ``least`` of the positives or more."""
    top = 1.0
    for half in (0, 1):
        fitted = fit_nnpu(positive[half::2], unlabelled[half::2], 0.5, steps=300, unbiased=False)
        p, u = (np.sort(fitted.score(x[1 - half :: 2])) for x in (positive, unlabelled))
        if not len(p) or not len(u):
            continue
        at = np.unique(p[: int(len(p) * (1 - least)) + 1])
        in_p, in_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        # both shares are measured: allow each its standard error, so that a chance low doesn't count
        wide = np.sqrt(in_u * (1 - in_u) / len(u)) + np.sqrt(in_p * (1 - in_p) / len(p))
        top = min(top, float(((in_u + wide) / in_p).min()))
    return float(np.clip(top, 0.02, 0.98))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel | None:
    """Fit on ``docs`` whose key passes ``learn``: rows labelled 1 are the positives, all such rows the unlabelled text.

    ``sample`` rows of each kind at most come to the driver, as features; an id that several rows or labels share counts once, with its least text. Without
    any positive or any text there is no model: None.
    """
    own = docs.where(learn & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    ids = labels.where(learn & F.col(key).isNotNull() & (F.col(label) == 1)).select(F.col(key).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = own.select("__id").distinct().orderBy(F.xxhash64("__id", F.lit("u")), "__id").limit(sample)
    roles = ids.select("__id", F.lit(1).alias("__role")).unionByName(chosen.select("__id", F.lit(0).alias("__role"))).withColumnRenamed("__id", "__of")
    # 2 * sample ids at most, so a broadcast; of rows that share an id, one goes on
    texts = own.join(F.broadcast(roles), F.col("__id") == F.col("__of")).groupBy("__role", "__id").agg(F.min("__text").alias("__text"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"role": batch["__role"], "x": [features(t) for t in batch["__text"]]}

    rows = texts.select("__role", "__text")
    got = map_arrow(rows, run, "role int, x array<double>", pa.schema([("role", pa.int32()), ("x", pa.list_(pa.float64()))])).toPandas()
    split = {role: np.array(sorted(part["x"].map(tuple))) for role, part in got.groupby("role")}
    if 1 not in split or 0 not in split:
        return None
    mixed = {role: x[np.random.default_rng(0).permutation(len(x))] for role, x in split.items()}
    return fit_nnpu(mixed[1], mixed[0], estimate_prior(mixed[1], mixed[0]))


def score_quality(df: DataFrame, model: QualityModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the model's score of each whole text (null: empty); 0.5 without a model. An existing ``out`` is replaced."""
    plain = df.drop(out)
    names = plain.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            if model is None or not texts:
                score = np.full(len(texts), 0.5)
            else:
                score = model.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, out])

    return plain.mapInArrow(run, plain.withColumn(out, F.lit(0.0)).schema)


def quality_predictions(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted. ``held_out`` is a condition on ``key``; labels of such rows are not read."""
    held = F.coalesce(held_out, F.lit(False))
    model = fit_quality(docs, labels, ~held, key, text)
    rows = docs.select(F.col(key).cast("long").alias(key), text)
    scored = score_quality(rows, model, text).drop(text)
    return scored.select(key, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
