"""Language identification of whole texts, with spans of mixed-language text.

Learning counts, for each language, hashed letter trigrams of words (``^`` and ``$`` at the ends) and the scripts its letters
come from, over all documents that may be learned from. A word's script narrows the candidate languages to
those seen in that script; its score in each is the mean-smoothed log probability of its trigrams, as a log posterior with a
floor. Viterbi over the words, with a penalty for each switch, labels every word; runs of one label are spans. The prediction is
the language of the most letters, the score its share of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BUCKETS, PENALTY, FLOOR, NONE = 1 << 15, 6.0, -8.0, "und"
#: Languages at most: a model has 128 KB for each, in every worker. More raise an error.
LANGUAGES = 1000
WORD = re.compile(r"[^\W\d_]+")
#: First code point of ranges, by script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_ID = [SCRIPT_NAMES.index(s) for _, s in SCRIPTS]


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def script_of(word: str) -> int:
    """The script of a word's first letter."""
    first = ord(word[0])
    return _SCRIPT_ID[0] if first < 0x370 else _SCRIPT_ID[bisect_right(_STARTS, first) - 1]


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every trigram of ``^word$``."""
    line = "\n".join("^" + w + "$" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = codes == 10
    owner = np.cumsum(breaks)[:-2]
    inside = ~(breaks[:-2] | breaks[1:-1] | breaks[2:])
    mix = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    return owner[inside], (mix >> np.uint64(64 - 15))[inside].astype(np.int64)


@dataclass
class LanguageModel:
    """Log probabilities by bucket and language, and the languages seen in each script."""

    names: list[str]
    logp: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages, bool
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log posterior (floored) of each language for each word."""
        owner, bucket = trigram_buckets(words)
        total = np.zeros((len(words), len(self.names)))
        for j in range(len(self.names)):
            total[:, j] = np.bincount(owner, self.logp[bucket, j], len(words))
        total = np.where(self.allowed[[script_of(w) for w in words]], total, -1e9)
        total -= total.max(axis=1, keepdims=True)
        total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
        return np.maximum(total, FLOOR).astype(np.float32)

    def matrix(self, texts: list[list[str]], limit: int = 500_000) -> list[np.ndarray]:
        """The scores of the words of each text; those of distinct words are kept, up to ``limit``."""
        known = self.known
        if len(known) > limit:
            known.clear()
            self.rows = None
        new = list({w for words in texts for w in words if w not in known})
        if new:
            parts = [self.word_scores(new[i : i + 65536]) for i in range(0, len(new), 65536)]
            base = len(known)
            known.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = np.concatenate([*([self.rows] if self.rows is not None else []), *parts])
        if self.rows is None:
            self.rows = np.zeros((0, len(self.names)), np.float32)
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]

    def label(self, texts: list[list[str]], penalty: float = PENALTY) -> list[np.ndarray]:
        """The language index of every word of each text, by Viterbi; texts of like length are run together."""
        ids = self.matrix(texts)
        out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(ids[order[stop]]) <= 400_000:
                stop += 1
            block = order[at:stop]
            for i, path in zip(block, viterbi([ids[i] for i in block], self.rows, penalty), strict=True):
                out[i] = path
            at = stop
        return out


def viterbi(ids: list[np.ndarray], rows: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best label sequences over ``rows[ids]``, for several sequences sorted by rising length."""
    sizes = np.array([len(x) for x in ids])
    longest, n = int(sizes[-1]), len(ids)
    grid = np.zeros((longest, n), np.int64)
    for j, x in enumerate(ids):
        grid[: len(x), j] = x
    firsts = np.searchsorted(sizes, np.arange(longest), side="right")  # sequences from here on have a word at this step
    value = np.zeros((n, rows.shape[1]), np.float32)
    best = np.zeros((longest, n), np.int16)
    jumped = np.zeros((longest, n, rows.shape[1]), bool)
    for t in range(longest):
        a = firsts[t]
        v = value[a:]
        if t:
            top = v.argmax(axis=1)
            best[t, a:] = top
            change = np.take_along_axis(v, top[:, None], 1) - penalty
            np.greater(change, v, out=jumped[t, a:])
            np.maximum(v, change, out=v)
        v += rows[grid[t, a:]]
    out = np.zeros((longest, n), np.int16)
    state = value.argmax(axis=1)
    lanes = np.arange(n)
    for t in range(longest - 1, -1, -1):
        a = firsts[t]
        out[t, a:] = state[a:]
        if t:
            jump = jumped[t, lanes[a:], state[a:]]
            state[a:] = np.where(jump, best[t, a:], state[a:])
    return [out[: len(x), j] for j, x in enumerate(ids)]


def fit_languages(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Count over all rows that pass ``learn`` and have a language; None if there is none.

    What comes to the driver is one number per language and bucket or script, whatever the corpus. Over ``LANGUAGES``
    different values of ``lang`` raise an error: such a column holds something else.
    """
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different languages in column {lang}")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                words = words_of(t)
                np.add.at(own, trigram_buckets(words)[1], 1)
                scripts = np.bincount([script_of(w) for w in words], minlength=len(SCRIPT_NAMES)) if words else 0
                own[BUCKETS:] += scripts
        for name, own in counts.items():
            spots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(spots), pa.string()), pa.array(spots, pa.int32()), pa.array(own[spots], pa.int64())], names=["lang", "spot", "n"])

    got = rows.mapInArrow(run, "lang string, spot int, n long").groupBy("lang", "spot").agg(F.sum("n").alias("n")).toPandas()
    if got.empty:
        return None
    names = sorted(got["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(names)))
    table[got["spot"], got["lang"].map({x: i for i, x in enumerate(names)})] = got["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    allowed = scripts > 0.001 * scripts.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True  # a script that no language has: no narrowing
    return LanguageModel(names, logp.astype(np.float32), allowed)


def spans_of(model: LanguageModel, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in code points of the lower-cased text."""
    places = [(m.start(), m.end()) for m in WORD.finditer((text or "").lower()) if any(map(str.isalpha, m[0]))]
    path = model.label([words_of(text)])[0]
    out: list[tuple[int, int, str]] = []
    for (start, end), k in zip(places, path, strict=True):
        name = model.names[k]
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], end, name)
        else:
            out.append((start, end, name))
    return out


def detect_languages(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score and lang_spans (array of start, end, lang) to ``df``.

    A null text, one without letters, or no model at all: ``und``, score 0, no spans. Existing columns of these names are replaced.
    """
    plain = df.drop("lang_pred", "score", "lang_spans")
    names = plain.columns
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            pred, score = predict(model, texts)
            spans = [[{"start": a, "end": b, "lang": k} for a, b, k in spans_of(model, t)] if model else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(item))], names=[*names, "lang_pred", "score", "lang_spans"]
            )

    kind = "cast(null as array<struct<start:long,end:long,lang:string>>)"
    return plain.mapInArrow(run, plain.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("lang_spans", F.expr(kind)).schema)


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    if model is None:
        return [NONE] * len(texts), [0.0] * len(texts)
    words = [words_of(t) for t in texts]
    pred, score = [], []
    for own, path in zip(words, model.label(words), strict=True):
        if not own:
            pred.append(NONE)
            score.append(0.0)
            continue
        letters = np.bincount(path, np.fromiter(map(len, own), np.int64, len(own)), len(model.names))
        top = int(letters.argmax())
        pred.append(model.names[top])
        score.append(float(letters[top] / letters.sum()))
    return pred, score


def language_predictions(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: key, held_out, lang_pred, score. ``held_out`` is a condition on ``key``; such rows are not learned from."""
    held = F.coalesce(held_out, F.lit(False))
    model = fit_languages(docs, ~held, text, lang)

    def run(batch: dict[str, list]) -> dict[str, list]:
        pred, score = predict(model, batch[text])
        return {key: batch[key], "lang_pred": pred, "score": score}

    arrow = pa.schema([(key, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    out = map_arrow(docs.select(F.col(key).cast("long").alias(key), text), run, f"`{key}` long, lang_pred string, score double", arrow)
    return out.select(key, held.alias("held_out"), "lang_pred", "score")
