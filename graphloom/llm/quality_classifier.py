"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is taken in linear
time as half the sum over factors of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2. Features of a text are its
hashed words (share of all words, scaled), statistics of its structure, each in steps as an indicator, and,
where given, metadata columns as hashed indicators. Training is by AdaGrad in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import named, prepared
from graphloom.llm.vectext import U64, chunks, hashed_words, mix

WORD_BUCKETS = 1 << 14
STATS, STEPS, META_BUCKETS = 9, 12, 1 << 8
FEATURES = WORD_BUCKETS + STATS * STEPS + META_BUCKETS
FACTORS = 6
#: Labelled rows to learn from at most, taken by hash of their id; every text is scored.
MAX_TRAIN = 6000

_KIND = np.zeros(256, dtype=np.uint8)  # of bytes: 1 upper, 2 lower or other letters, 3 digit, 4 symbol, 5 punctuation, 6 line end
_KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@/"]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[10] = 6


def structure(texts: list[bytes], n_words: np.ndarray, n_distinct: np.ndarray, n_repeats: np.ndarray) -> np.ndarray:
    """STATS numbers between 0 and 1 for each text."""
    out = np.zeros((len(texts), STATS))
    for i, t in enumerate(texts):
        data = np.frombuffer(t, dtype=np.uint8)
        kinds = np.bincount(_KIND[data], minlength=7) / max(len(t), 1)
        shout = t.count(b"!!") / max(n_words[i], 1)
        out[i] = [kinds[1] / max(kinds[1] + kinds[2], 1e-9), kinds[3] * 4, kinds[4] * 4, kinds[5] * 2, kinds[6] * 10, shout, n_distinct[i] / max(n_words[i], 1), n_repeats[i] / max(n_words[i], 1), np.log1p(n_words[i]) / 12]
    return np.clip(out, 0, 1)


def features(texts: list[bytes], meta: list[tuple[str, ...]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, value) of texts, sorted by row."""
    rows, cols, vals = [], [], []
    for a, b in chunks(texts):
        hashed, first = hashed_words(texts[a:b], lower=False)
        n = np.diff(first)
        key = (np.repeat(np.arange(b - a, dtype=np.int64), n) << 14) | (hashed >> U64(50)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        row, col = key >> 14, key & (WORD_BUCKETS - 1)
        value = 2 * np.sqrt(count / n[row])
        repeats = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashed[1:] == hashed[:-1]])[: len(hashed)])])
        stats = structure(texts[a:b], n, np.bincount(row, minlength=b - a), repeats[first[1:]] - repeats[first[:-1]])
        step = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1) + np.arange(STATS) * STEPS + WORD_BUCKETS
        rows += [row + a, np.repeat(np.arange(a, b), STATS)]
        cols += [col, step.ravel()]
        vals += [value, np.full(step.size, 1.0)]
    for i, own in enumerate(meta or []):
        for k, x in enumerate(own):
            h = int(mix(np.array([hash_text(f"{k}:{x}")], dtype=U64))[0]) % META_BUCKETS
            rows, cols, vals = [*rows, np.array([i])], [*cols, np.array([WORD_BUCKETS + STATS * STEPS + h])], [*vals, np.array([0.5])]
    row, col, val = (np.concatenate(x) if x else np.zeros(0) for x in (rows, cols, vals))
    order = np.argsort(row, kind="stable")
    return row[order].astype(np.int64), col[order].astype(np.int64), val[order].astype(np.float32)


def hash_text(text: str) -> int:
    words, _ = hashed_words([text.encode().replace(b" ", b"_") or b"_"], lower=False)
    return int(words[0])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias) + np.bincount(row, weights=self.linear[col] * val, minlength=n)
        for f in range(self.factors.shape[1]):
            x = self.factors[:, f][col] * val
            z += 0.5 * (np.bincount(row, weights=x, minlength=n) ** 2 - np.bincount(row, weights=x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, least_steps: int = 1500, epochs: int = 12, batch: int = 32, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """AdaGrad on the logistic loss over sparse rows, in more epochs where few rows make few steps."""
    rng = np.random.default_rng(seed)
    n = len(y)
    prior = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    m = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, FACTORS)))
    g_lin, g_fac, g_bias = np.full(FEATURES, 1e-2), np.full((FEATURES, FACTORS), 1e-2), 1e-2
    begin = np.searchsorted(row, np.arange(n + 1))
    for _ in range(max(epochs, least_steps * batch // n) if n else 0):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            size = begin[part + 1] - begin[part]
            at = np.repeat(begin[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            c, v, r = col[at], val[at], np.repeat(np.arange(len(part)), size)
            vx = m.factors[c] * v[:, None]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, r, vx)
            z = m.bias + np.bincount(r, weights=m.linear[c] * v, minlength=len(part)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(r, weights=(vx**2).sum(axis=1), minlength=len(part)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            used, inverse = np.unique(c, return_inverse=True)
            d_lin = np.bincount(inverse, weights=error[r] * v) + decay * m.linear[used]
            d_each = error[r][:, None] * (v[:, None] * (sums[r] - vx))
            d_fac = np.stack([np.bincount(inverse, weights=d_each[:, f]) for f in range(FACTORS)], axis=1) + decay * m.factors[used]
            g_lin[used] += d_lin**2
            g_fac[used] += d_fac**2
            g_bias += error.sum() ** 2
            m.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
            m.factors[used] -= rate * d_fac / np.sqrt(g_fac[used])
            m.bias -= rate * error.sum() / np.sqrt(g_bias)
    return m


def _sparse(batch: pa.RecordBatch, meta: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    extra = [batch.column(batch.num_columns - meta + k).to_pylist() for k in range(meta)]
    return features(texts, list(zip(*extra, strict=True)) if meta else None), len(texts)


def learn_quality(docs: DataFrame, labels: DataFrame, metadata: list[str] | None = None, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """A machine for P(label = 1) from docs (doc_id, text, metadata) and labels (doc_id, label).

    At most max_train labels are used, the first by hash of doc_id; null ids and labels are left out, and an id
    labelled both ways counts as the higher. Of rows of docs that repeat an id the one with the least digest of its text and
    metadata is learnt from, so reruns agree; only features reach the driver, max_train rows of them at most. Without any label the machine scores 0.5.
    """
    spark = docs.sparkSession
    prepared(spark)
    meta = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"meta_{k}") for k, c in enumerate(metadata or [])]
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen_rows = [(r.doc_id, int(r.label)) for r in chosen.collect()]  # max_train rows at most
    picked = spark.createDataFrame(chosen_rows, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta).join(F.broadcast(picked), "doc_id")
    n_meta = len(meta)
    ready = texts.select("doc_id", "text", "label", F.md5(F.to_json(F.struct("text", *[f"meta_{k}" for k in range(n_meta)]))).alias("digest"), *[f"meta_{k}" for k in range(n_meta)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            (row, col, val), n = _sparse(batch, n_meta)
            stops = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x)) for x in (col.astype(np.int32), val)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *lists], ["doc_id", "label", "digest", "cols", "vals"])

    each = ready.mapInArrow(batches, "doc_id long, label int, digest string, cols array<int>, vals array<float>")
    one = each.groupBy("doc_id").agg(F.min_by(F.struct("label", "cols", "vals"), "digest").alias("row")).select("doc_id", "row.*")
    held = one.toArrow().to_pandas().sort_values("doc_id")
    if not len(held):
        return train(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    row = np.repeat(np.arange(len(held)), held.cols.map(len))
    return train(row, np.concatenate(held.cols.to_list()).astype(np.int64), np.concatenate(held.vals.to_list()), held.label.to_numpy(dtype=float))


def with_quality(docs: DataFrame, model: FactorisationMachine, metadata: list[str] | None = None) -> DataFrame:
    """docs, all columns, with score (0 to 1) of every row; an existing column score is replaced.

    docs: text and the metadata columns. A null or empty text has no words and is scored by its structure alone;
    repeated rows are scored each, a very long text whole, and an empty table gives an empty result. Nothing is joined: rows pass through the scorer.
    """
    spark = docs.sparkSession
    prepared(spark)
    held = spark.sparkContext.broadcast(model)  # fixed size: FEATURES x (FACTORS + 1)
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != "score"])
    meta = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"meta_{k}") for k, c in enumerate(metadata or [])]
    names, n_meta = docs.columns, len(meta)
    at = [c.lower() for c in names].index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sparse, n = _sparse(batch.select([at, at, *range(len(names), batch.num_columns)]), n_meta)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(held.value.scores(*sparse, n))], [*names, "score"])

    by_place = docs.select(*[named(c).alias(f"column_{k}") for k, c in enumerate(names)], *meta)  # names may hold dots
    return by_place.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def score_quality(docs: DataFrame, model: FactorisationMachine, metadata: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text, metadata), as by with_quality."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(metadata or []))
    return with_quality(chosen, model, metadata).select("doc_id", "score")
