"""Language identification by hierarchical discrimination.

A text's features are its hashed byte trigrams. Linear one-versus-rest scores choose the language
family; within the family, one-versus-one linear support vector machines separate the closely
related languages by vote. Models are trained here on a bounded sample of labelled rows; the
whole of every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialize

DIMS = 4096
#: Training documents of a language, and of all languages, at most (those with the lowest hashes).
PER_LANG, TRAIN_ROWS = 1_500, 12_000
#: Families of related languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne gu pa ur",
    "sinitic": "zh yue wuu",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_plain_letter = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    return bool(_plain_letter(text)) or any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(text: str) -> np.ndarray:
    """Damped, unit-length counts of hashed trigrams of the lower-cased text, blanks as one space."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(DIMS, dtype=np.float32)
    keys = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    keys = ((keys ^ (keys >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    x = np.log1p(np.bincount(keys, minlength=DIMS)).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Averaged stochastic subgradient steps for the hinge loss; weights with the bias last."""
    rng, n = np.random.default_rng(seed), len(x)
    w, mean, t = np.zeros(x.shape[1] + 1, dtype=np.float64), np.zeros(x.shape[1] + 1), 0
    share = {s: max(int((y == s).sum()), 1) / n for s in (-1, 1)}
    weight = np.where(y > 0, 0.5 / share[1], 0.5 / share[-1])
    for epoch in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            rows = order[k : k + 64]
            t += 1
            a = x[rows]
            wrong = y[rows] * (a @ w[:-1] + w[-1]) < 1
            rate = 1.0 / (ridge * (t + 100))
            push = (weight[rows] * y[rows])[wrong]
            w[:-1] = (1 - rate * ridge) * w[:-1] + rate / len(rows) * (push @ a[wrong])
            w[-1] += 0.1 * rate * ridge * push.sum()
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, np.linalg.norm(mean[:-1])) * 10


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores in [0, 1]: the family's share times the language's mean vote."""
        margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        shares = np.exp(margins - margins.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        chosen = margins.argmax(axis=1)
        out, score = np.empty(len(x), dtype=object), shares[np.arange(len(x)), chosen]
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            langs = self.langs[family]
            if not len(rows):
                continue
            if len(langs) == 1:
                out[rows] = langs[0]
                continue
            w = self.pair_weights[family]
            first = 1 / (1 + np.exp(-np.clip(x[rows] @ w[:, :-1].T + w[:, -1], -30, 30)))
            votes = np.zeros((len(rows), len(langs)))
            for k, (a, b) in enumerate(self.pairs[family]):
                votes[:, a] += first[:, k]
                votes[:, b] += 1 - first[:, k]
            best = votes.argmax(axis=1)
            out[rows] = np.array(langs, dtype=object)[best]
            score[rows] *= votes[np.arange(len(rows)), best] / (len(langs) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """Family scores and the pairwise machines of each family; None without rows."""
    if not langs:
        return None
    names = np.array(langs, dtype=object)
    family = np.array([family_of(v) for v in langs], dtype=object)
    families = sorted(set(family))
    tops = [fit_svm(x, np.where(family == f, 1, -1)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in families]
    members = {f: sorted(set(names[family == f])) for f in families}
    pairs = {f: [(a, b) for a in range(len(m)) for b in range(a + 1, len(m))] for f, m in members.items()}
    machines = {}
    for f, m in members.items():
        rows = []
        for a, b in pairs[f]:
            both = (names == m[a]) | (names == m[b])
            rows.append(fit_svm(x[both], np.where(names[both] == m[a], 1, -1)))
        machines[f] = np.array(rows, dtype=np.float32).reshape(-1, x.shape[1] + 1)
    return Model(families, np.array(tops, dtype=np.float32), members, pairs, machines)


def _remainder():
    """crc32 of the id as text, modulo 4; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, at, values = [], [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            if text and has_letter(text):
                x = features(text)
                langs.append(lang)
                at.append(np.flatnonzero(x).astype(np.int16).tobytes())
                values.append(x[x > 0].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "x"])


def train(docs: DataFrame, per_lang: int = PER_LANG, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on rows whose crc32(doc_id) modulo 4 isn't 2 and whose lang isn't null.

    At most `per_lang` of a language and `rows` in all are taken, those of the lowest hashes of id
    and text; rows that repeat count once.
    """
    lang, text = F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    known = docs.where((_remainder() != 2) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = known.select(lang, text, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    # a row per language; a share of hashes then leaves about twice what a language may have, wherever its rows are
    counts = few(materialize(known.groupBy("lang").agg(F.count("*").alias("rows")), "lang-counts"))
    below = F.least(F.lit(1.0), 2.0 * per_lang / F.col("rows")) * (1 << 62)
    low = known.join(counts, "lang").where(F.shiftrightunsigned("h", 2) < below).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    low = low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).orderBy("n", "lang").limit(rows).select("lang", "h")
    texts = known.join(F.broadcast(materialize(low, "lang-rows")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")
    found = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in texts.mapInArrow(_rows, "lang string, at binary, x binary").collect())
    x = np.zeros((len(found), DIMS), dtype=np.float32)
    for i, (_, at, values) in enumerate(found):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(values, np.float32)
    return fit(x, [r[0] for r in found])


def predict_languages(docs: DataFrame, per_lang: int = PER_LANG, rows: int = TRAIN_ROWS, model: Model | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): held_out, lang_pred, score.

    Texts that are null or have no letter are `und` with score 0; so is everything if no row has a
    language to learn from. Repeated rows and null doc_ids are kept; lang is only learned from; other
    columns are ignored; an empty table gives no rows. The model is trained before this returns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, per_lang, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            langs, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for k in range(0, b.num_rows, 512):
                rows, xs = [], []
                for i in range(k, min(k + 512, b.num_rows)):
                    text = b.column(2)[i].as_py()
                    if known and text and has_letter(text):
                        rows.append(i)
                        xs.append(features(text))
                if rows:
                    found, score = known.predict(np.array(xs))
                    scores[rows] = score
                    for i, lang in zip(rows, found):
                        langs[i] = lang
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_remainder() == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
