"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its letter trigrams and 4-grams, taken on UTF-8 bytes inside words with a
mark at either end, and hashed to rows of an embedding table. The mean of a text's embeddings goes through a
linear softmax. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of
labelled texts; part of the sample is held back to fit a temperature and the score under which an answer counts
as rejected. As mean and linear layer commute, prediction needs one row of label scores a subword.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepared
from graphloom.llm.vectext import chunks

BUCKETS = 1 << 15
#: Labelled texts to learn from at most, taken by hash of their id; every text is scored.
MAX_TRAIN = 3000
UNKNOWN = "und"
#: A longer text is scored and learnt from piece by piece.
PIECE_BYTES = 1 << 20

_FOLD = np.zeros(256, dtype=np.uint8)  # 0 parts words; letters A-Z are lower-cased; bytes of other letters stay
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[97 + _c] = _FOLD[65 + _c] = 97 + _c


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of the texts, and the text that it belongs to."""
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    data = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = data > 0
    three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    ok3 = letter[1:-1] & (letter[:-2] | letter[2:])
    ok4 = ok3[:-1] & letter[2:-1] if len(data) > 3 else np.zeros(0, dtype=bool)
    four = (three[:-1] * np.uint32(0x9E3779B1)) ^ (data[3:] * np.uint32(0x85EBCA6B))
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    b3 = (three[ok3] * np.uint32(0xCC9E2D51)) >> shift
    b4 = (four[ok4] * np.uint32(0x1B873593)) >> shift
    return np.concatenate([b3, b4]), np.concatenate([owner[:-2][ok3], owner[:-3][ok4]])


def pieces(texts: list[bytes], size: int = PIECE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts cut into pieces of at most size bytes, at a space where a piece has one, and the text of each piece: memory follows size, not the text."""
    out, owner = [], []
    for i, t in enumerate(texts):
        start = 0
        while len(t) - start > size:
            cut = t.rfind(b" ", start + 1, start + size) + 1 or start + size
            out.append(t[start:cut])
            owner.append(i)
            start = cut
        out.append(t[start:])
        owner.append(i)
    return out, np.array(owner, dtype=np.int64)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords, and the share of its subwords in each."""
    count = np.zeros(BUCKETS, dtype=np.int64)
    for piece in pieces([text])[0]:
        count += np.bincount(subwords([piece])[0], minlength=BUCKETS)
    found = np.flatnonzero(count)
    return found.astype(np.int32), (count[found] / max(count.sum(), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    """labels, and for each bucket the label scores that its embedding yields."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, texts x labels."""
        out, count = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), dtype=np.int64)
        cut, of = pieces(texts)
        for a, b in chunks(cut):
            buckets, owner = subwords(cut[a:b])
            count += np.bincount(of[a:b][owner], minlength=len(texts))
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(of[a:b][owner], weights=self.table[:, k][buckets], minlength=len(texts))
        return softmax((out / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, epochs: int = 8, rate: float = 4.0, seed: int = 11) -> LanguageModel:
    """Fit the two layers by SGD on nine texts of ten (as bags of subwords), temperature and rejection on the tenth."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels)), dtype=np.float32), np.zeros(len(labels), dtype=np.float32)
    order = rng.permutation(len(bags))
    held = order[: len(order) // 10] if len(order) >= 50 else order
    fit = order[len(order) // 10 :] if len(order) >= 50 else order
    steps, at = epochs * max(len(fit), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            b, w = bags[i]
            mean = w @ emb[b]
            p = softmax((mean @ out + bias)[None, :])[0]
            p[y[i]] -= 1
            step = rate * (1 - at / steps)
            back = out @ p
            out -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            emb[b] -= step * w[:, None] * back[None, :]
            at += 1
    table = (emb @ out).astype(np.float32)
    logits = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in held]).reshape(len(held), len(labels))
    truth = y[held]

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()) if len(truth) else 0.0

    temperature = min((float(t) for t in np.geomspace(0.25, 10, 40)), key=loss)
    best = softmax(logits / temperature).max(axis=1) if len(truth) else np.ones(1)
    return LanguageModel(labels, table, bias, temperature, float(np.quantile(best, 0.01)) * 0.9)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def learn_languages(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel | None:
    """A model of (doc_id, text, lang) from at most max_train texts, the first by hash of doc_id; None without any labelled text.

    Rows without id, text or lang, and texts without a letter, are left out. Of rows that repeat a doc_id the one of least
    language, then least digest of the text, is learnt from, so reruns agree. Only subword counts reach the driver, max_train rows of them at most.
    """
    spark = labelled.sparkSession
    prepared(spark)
    usable = labelled.where("lang is not null and text is not null and doc_id is not null")
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    picked = spark.createDataFrame([(r.doc_id,) for r in ids.collect()], "doc_id long")  # max_train ids at most
    chosen = usable.join(F.broadcast(picked), "doc_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _has_letter(text):
                    data = text.encode()
                    found, n = bag(data)
                    rows.append((doc_id, lang, hashlib.sha256(data).digest(), found, n))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "lang", "digest", "buckets", "weights"])

    bags = chosen.mapInArrow(batches, "doc_id long, lang string, digest binary, buckets array<int>, weights array<float>")
    one_each = bags.groupBy("doc_id").agg(F.min_by(F.struct("lang", "buckets", "weights"), F.struct("lang", "digest")).alias("row"))
    held = one_each.select("doc_id", "row.*").toArrow().to_pandas().sort_values("doc_id")
    return train([(np.asarray(b), np.asarray(w)) for b, w in zip(held.buckets, held.weights, strict=True)], held.lang.to_list()) if len(held) else None


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs' doc_id with lang_pred (a learned label, or und), score (0 to 1) and accepted.

    docs: doc_id and text; nothing else is read, so other columns may have any name. A null text, or one without a letter, is und
    with score 0, and so is any text without a model. accepted is false for und and for a calibrated score below the model's bound.
    Repeated rows are scored each; a very long text is scored whole, piece by piece; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepared(spark)
    held = spark.sparkContext.broadcast(model)  # 0.5 MB: buckets x labels

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known = np.array([m is not None and _has_letter(t) for t in texts], dtype=bool)
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known.any():
                p = m.scores([t.encode() for t, k in zip(texts, known, strict=True) if k])
                lang[known], score[known] = np.array(m.labels, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            accepted = known & (score >= (m.reject_below if m else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(batches, "doc_id long, lang_pred string, score double, accepted boolean")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))
