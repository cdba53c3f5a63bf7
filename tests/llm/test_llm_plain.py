"""Features and scores against plain versions; small sources and many shards of the mix; names of columns through the pipeline."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from test_llm import DATA, odd_docs

import corpus_pipeline
from graphloom.llm import chat_format, language_id, mixing, quality_classifier
from graphloom.llm.vectext import hashed_words

TEXTS = ["", " ", "a", "Un été à la mer, 12 fois!", "AB cd\nEF", "x" * 50, "żółć łąka", "one two two\tthree !! three", "the cat sat on the mat " * 40]


def plain_subwords(text):
    """Buckets of the byte 3-grams around a letter and 4-grams of them, of a text between two spaces, A-Z lowered and other signs made breaks."""
    low = [c + 32 if 65 <= c <= 90 else c for c in b" " + text.encode() + b" "]
    data = [c if 97 <= c <= 122 or c >= 128 else 0 for c in low]
    out, wrap = [], (1 << 32) - 1
    bits = 32 - int(math.log2(language_id.BUCKETS))
    for i in range(len(data) - 2):
        a, b, c = data[i : i + 3]
        if b and (a or c):
            out.append(((((a << 16) | (b << 8) | c) * 0xCC9E2D51) & wrap) >> bits)
            if c and i + 3 < len(data):
                four = ((((a << 16) | (b << 8) | c) * 0x9E3779B1) & wrap) ^ ((data[i + 3] * 0x85EBCA6B) & wrap)
                out.append(((four * 0x1B873593) & wrap) >> bits)
    return out


def test_languages_are_scored_by_the_mean_of_subword_embeddings():
    for t in TEXTS:
        buckets, owner = language_id.subwords([t.encode()])
        assert sorted(buckets.tolist()) == sorted(plain_subwords(t)) and not owner.any()
    rng = random.Random(1)
    words = {"x": ["lorem", "ipsum", "dolor"], "y": ["żar", "łan", "kość"]}
    texts = [(k, " ".join(rng.choice(own) for _ in range(20))) for k, own in words.items() for _ in range(40)]
    model = language_id.train([language_id.bag(t.encode()) for _, t in texts], [k for k, _ in texts])
    scores = model.scores([t.encode() for t in TEXTS])
    for t, got in zip(TEXTS, scores, strict=True):
        own = plain_subwords(t)
        mean = [sum(float(model.table[b, k]) for b in own) / max(len(own), 1) for k in range(2)]
        e = [math.exp((m + float(model.bias[k])) / model.temperature) for k, m in enumerate(mean)]
        assert np.allclose(got, [x / sum(e) for x in e], atol=1e-5)
    assert [model.labels[s.argmax()] for s in model.scores([b"dolor lorem", "łan żar".encode()])] == ["x", "y"]


def plain_features(text, meta=()):
    """Feature: value of hashed words by root share, of nine statistics by step, and of metadata."""
    words, data, out = text.encode().split(), text.encode(), {}
    bucket = lambda w: int(hashed_words([w], lower=False)[0][0]) >> 50
    for w in words:
        out[bucket(w)] = out.get(bucket(w), 0) + 1
    out = {k: 2 * math.sqrt(n / len(words)) for k, n in out.items()}
    share = lambda signs: sum(c in signs for c in data) / max(len(data), 1)
    upper, lower = share(range(65, 91)), share([*range(97, 123), *range(128, 256)])
    stats = [
        upper / max(upper + lower, 1e-9), share(range(48, 58)) * 4, share(b"#*$%&|<>{}[]\\^~_=+@/") * 4, share(b".,;:!?'\"()-") * 2, share(b"\n") * 10,
        data.count(b"!!") / max(len(words), 1), len({bucket(w) for w in words}) / max(len(words), 1), sum(a == b for a, b in zip(words[1:], words, strict=False)) / max(len(words), 1), math.log1p(len(words)) / 12,
    ]
    steps = quality_classifier.STEPS
    for k, x in enumerate(stats):
        out[quality_classifier.WORD_BUCKETS + k * steps + min(int(min(max(x, 0), 1) * steps), steps - 1)] = 1.0
    return out


def test_quality_features_are_those_of_a_plain_version():
    row, col, val = quality_classifier.features([t.encode() for t in TEXTS])
    for i, t in enumerate(TEXTS):
        own = dict(zip(col[row == i].tolist(), val[row == i].tolist(), strict=True))
        want = plain_features(t)
        assert set(own) == set(want) and all(abs(own[k] - want[k]) < 1e-6 for k in want), t
    row, col, val = quality_classifier.features([b"a", b"a", b"b"], [("web", "1"), ("web", "2"), ("web", "1")])
    meta = [set(col[(row == i) & (col >= quality_classifier.FEATURES - quality_classifier.META_BUCKETS)].tolist()) for i in range(3)]
    assert meta[0] == meta[2] != meta[1] and all(len(m) == 2 for m in meta) and len(meta[0] & meta[1]) == 1


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(2)
    rows = [(100 * s + k, " ".join(["w"] * rng.randrange(1, 6)), f"s{s:02}") for s in range(40) for k in range(rng.randrange(1, 5))]
    for docs in (rows, rows[:3], [(1, "a", "x")]):
        got = mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
        taken, target = {}, {r.source: r.target for r in got}
        for r in got:
            taken[r.source] = taken.get(r.source, 0) + r.taken
            assert r.taken <= 3 * r.size
        assert all(abs(taken[s] - t) <= max(1.5, t / mixing.LEAST_BLOCKS) for s, t in target.items()) and abs(sum(taken.values()) - sum(target.values())) <= 1
    none = mixing.mixed(spark.createDataFrame([(1, "", "x"), (2, None, "y")], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2


def test_shards_in_groups_share_their_sources_quota(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), "hot" if k % 3 else "cold") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mixing.mixed(docs, shard_tokens=400).collect()
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 5)
    many = mixing.mixed(docs, shard_tokens=400).collect()
    assert len({r.shard for r in many if r.source == "hot"}) > 20

    def by(rows, *names):
        out = {}
        for r in rows:
            key = tuple(r[n] for n in names)
            size, taken = out.get(key, (0, 0))
            out[key] = (size + r["size"], taken + r.taken)
        return out

    block = mixing.BLOCK_TOKENS
    for rows_ in (one, many):
        whole, target = by(rows_, "source"), {r.source: r.target for r in rows_}
        assert all(abs(taken - target[s]) <= 2 * block for (s,), (_, taken) in whole.items())
        for (s, _), (size, taken) in by(rows_, "source", "shard").items():
            assert abs(taken - size * whole[s,][1] / whole[s,][0]) <= 3 * block  # a shard's part is its share of the source's
        assert all(r.taken <= 3 * r["size"] for r in rows_)


def test_a_null_conversation_has_no_turns(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "conv_id long, conversation string")
    found = [tuple(r)[1:] for r in chat_format.digests(df, "conv_id").collect()]
    assert found[0] == found[1] and found[0][0] == 0 == found[0][2]


def test_names_of_columns_pass_through_the_stages(spark):
    extra = {"a.b": 1, "score": 2, "Score_aside": 3, "n_dropped": 4, "keys": 5, "`x": 6}
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(v).alias(k) for k, v in extra.items()])
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert len(rows) <= n
        if name == "source_mixing":
            assert len(rows) == n
        else:
            assert rows and out.columns == docs.columns and all(tuple(r)[5:] == tuple(extra.values()) for r in rows)
