"""Embedding whitening, periodic runs and token files against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import periodic_runs, queries, token_files, whitening
from graphloom.llm.common import table

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)

# --- whitening ----------------------------------------------------------------------------------------------------------------------


def brute_fit(rows):
    """Distinct integer vectors, their exact sums, and the covariance from fractions."""
    fit = sorted({tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in rows})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dim)]
    off = [[n * x[d] - sums[d] for d in range(dim)] for x in fit]
    return fit, sums, [[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(dim)] for i in range(dim)]


def test_whitening_query_has_the_values_of_exact_fractions(spark):
    given_ = {r.vec_id: r.embedding for r in table(spark, DATA, "embeddings").collect()}
    fit, sums, covariance = brute_fit(given_.values())
    n, values, axes = len(fit), *np.linalg.eigh(np.array(covariance))
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    found = queries.op11_embedding_whitening(spark, DATA).collect()
    assert len(found) == 16 * len(given_) and {r.component for r in found} == set(range(1, 17))
    signs = {}
    for r in found:
        x = [int(np.floor(64 * float(c))) + 1_000_000 for c in given_[r.vec_id]]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1]))
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, want * r.whitened > 0) == (want * r.whitened > 0)
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("scale", [1, 64, 1_000_003])
def test_scatter_is_exact_for_large_entries(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 10.0 ** rng.integers(-2, 7), 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    fit = whitening.usable(df, "embedding", scale, 3, F.col("vec_id")).select("x").distinct()
    xs = [r.x for r in fit.collect()]
    assert sorted(tuple(x) for x in xs) == sorted({tuple(int(np.floor(c * scale)) + 3 for c in v) for _, v in rows})
    n, sums, widest = whitening.moments(fit, 5)
    assert n == len(xs) and list(sums) == [sum(x[d] for x in xs) for d in range(5)] and widest == max(max(x[d] for x in xs) - min(x[d] for x in xs) for d in range(5))
    off = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in xs]
    assert whitening.scatter(fit, n, sums, widest) == [[sum(o[i] * o[j] for o in off) for j in range(5)] for i in range(5)]
    model = whitening.learn_whitening(df, scale=scale, offset=3)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model, scale=scale, offset=3).collect()}
    assert got == {k: sum((n * (int(np.floor(c * scale)) + 3) - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in rows}
    assert model.identity_error < 1e-6


def test_primes():
    found = whitening.primes_below(2**21, 10**40)
    assert len(found) >= 2 and np.prod([float(p) for p in found]) > 1e40
    assert all(all(p % d for d in range(2, 1449)) for p in found)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (None, [3.0, 2.0], "c"), (2, None, "d"), (3, [1.0, None], "e"), (4, [nan, 1.0], "f"), (5, [inf, 1.0], "g"), (6, [1.0], "h"), (7, [], "i"), (8, [1e300, 0.0], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `a.x` string").withColumn("x", F.lit(1)).withColumn("key", F.lit(2))
    model = whitening.learn_whitening(df)
    assert model.n == 2 and model.sums == (2 * 1_000_000 + 64 * 4, 2 * (1_000_000 + 128))
    found = sorted((r.vec_id or 0, int(r.deviation), [None if v is None else abs(round(v, 9)) for v in r.whitened]) for r in whitening.whiten(df, model).collect())
    assert found == [(0, 128**2, [1.0, None]), (1, 128**2, [1.0, None]), (1, 128**2, [1.0, None])]
    assert model.identity_error < 1e-12 and model.eigenvalues[1] == 0
    same = df.where("vec_id = 1")
    flat = whitening.learn_whitening(same)
    assert flat.n == 1 and flat.trace == 0 and flat.identity_error is None
    assert [r.whitened for r in whitening.whiten(same, flat).collect()] == [[None, None]] * 2
    assert whitening.learn_whitening(df.where("false")) is None
    assert whitening.whiten(df, None).collect() == []


# --- runs ---------------------------------------------------------------------------------------------------------------------------


def brute_runs(w, least):
    """Every maximal stretch of each period whose smallest period that is."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            own = w[i : i + length]
            if j > i and length >= max(least, 3 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 6)), max_size=8), st.sampled_from([3, 6, 24]))
def test_runs_are_those_of_every_stretch(parts, least):
    w = [x for block, times in parts for x in block * times]
    assert periodic_runs.find_runs(np.array(w, dtype=np.int64), least) == brute_runs(w, least)


@pytest.mark.parametrize("grid", [1, 7, 65_536])
def test_runs_do_not_depend_on_the_grid_size(grid, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", grid)
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 9)) for _ in range(6)])
        assert periodic_runs.find_runs(w, 6) == brute_runs(w.tolist(), 6)


def test_long_stretches_take_little_time():
    assert periodic_runs.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    block = np.arange(90_000)
    assert periodic_runs.find_runs(np.tile(block, 3)) == [(0, 270_000, 90_000)]


def planted(doc_id, text):
    words = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_run_query_has_the_rows_of_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert set(found) == set(docs) and sum(r.n_runs > 0 for r in found.values()) > 10
    for k, text in docs.items():
        words, r = planted(k, text), found[k]
        runs = brute_runs(words, 24)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 24), (5, "a\x0bb\x0cc " * 8 + "a"), (6, "a b " * 30), (None, "x " * 30), (7, "b " * 23), (7, "b " * 23), (8, "w%d " * 5 + " ".join(f"u{i % 100}" for i in range(300)) + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "runs": F.lit("r"), "a.b": F.lit(2)})
    found = sorted(((r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect())
    want = [(k or 0, len((t or "").encode().split()), brute_runs((t or "").encode().split(), 24)) for k, t in rows]
    assert [x[:3] for x in found] == sorted(want, key=lambda x: x[0])
    assert {x[0]: x[3] for x in found}[5] == "a b c" and {x[0]: x[3] for x in found}[1] == ""
    assert periodic_runs.periodic_runs(df.where("false")).collect() == []
    odd = periodic_runs.digests(periodic_runs.periodic_runs(df.where("doc_id = 1"))).first()
    assert odd.n_runs == 0 and odd.start is None and odd.collapsed_sha256 == hashlib.sha256(b"").hexdigest() == odd.runs_sha256


# --- token files --------------------------------------------------------------------------------------------------------------------


def whole_ids(text):
    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85  ́'sΣσAé!1<|endoftext|>")), max_size=60))
def test_ids_word_by_word_are_those_of_the_whole_text(text):
    with open(VOCABULARY, "rb") as file:
        ids_of = token_files.text_encoder(file.read())
    assert isinstance(ids_of.__self__, token_files.WordIds)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids_of([text, "", text])] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in (text, "", text)]


def test_few_remembered_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_HELD", 20)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(token_files, "WORD_BYTES", 6)
    placed = lambda text: (TOKENIZER.encode(text, add_special_tokens=False).ids, TOKENIZER.encode(text, add_special_tokens=False).offsets)
    memory = token_files.WordIds(placed)
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", "Élan", "ΣΑΣ", "don't", "ﬁ", "x.y,z", "🙂🙂", "<|endoftext|>"]) + str(rng.integers(0, 30)) for _ in range(8)) for _ in range(3)]
        assert [np.frombuffer(x, "<i4").tolist() for x in memory.of(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(memory.held) <= 20 and all(len(w) <= 6 for w in memory.held)


def test_a_tokenizer_that_keeps_spaces_encodes_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        ids_of = token_files.text_encoder(file.read())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a  b\n", add_special_tokens=False).ids
    assert not hasattr(ids_of, "__self__") and np.frombuffer(ids_of(["a  b\n"])[0], "<i4").tolist() == whole


def test_token_file_query_has_the_ids_of_whole_texts(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    start = 0
    found = {r.doc_id: r for r in queries.op13_token_files(spark, DATA).collect()}
    for r in sorted(table(spark, DATA, "documents").collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = found.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert not found


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Token files of odd documents in several parts, small row groups and pages; and the rows in order."""
    rows = [(k, f"doc {k} says {'word ' * (k % 17)}") for k in range(400, 0, -1)] + [(None, "no id"), (None, None), (5, ""), (5, ""), (6, "x<|endoftext|>y"), (7, "l" * 100_000 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("p"), "ids": F.lit(1), "a.b": F.lit(2)})
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_token_files(df, path, row_group_bytes=4096, row_group_rows=30, page_bytes=512, page_rows=20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    return path, rows


def test_token_files_hold_documents_in_order(spark, files):
    path, rows = files
    found = sorted(token_files.token_rows(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in found] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    assert sorted((r.doc_id or 0, r.ids) for r in found) == sorted((k or 0, whole_ids(t)) for k, t in rows)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert spark.read.parquet(f"{path}/index").count() > 1


def test_token_ranges(spark, files):
    path, _ = files
    every = [x for r in sorted(token_files.token_rows(spark, path).collect(), key=lambda r: r.start) for x in r.ids]
    for a, b in ((0, 1), (10, 500), (len(every) - 3, len(every) + 9), (0, len(every)), (7, 7), (len(every), len(every) + 5)):
        found = sorted(token_files.token_range(spark, path, a, b).collect(), key=lambda r: r.start)
        assert [x for r in found for x in r.ids] == every[a:b]


def test_selective_reads_and_encodings(spark, files, tmp_path):
    path, rows = files
    plan = token_files.token_rows(spark, path, F.col("doc_id").between(5, 9), ids=False)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "doc_id" in x and "n_tokens" in x and "PushedFilters" in x)
    assert "ids" not in scan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,5)" in scan
    assert sorted(r.doc_id for r in token_files.token_rows(spark, path, F.col("doc_id").between(5, 9)).collect()) == [5, 5, 5, 6, 6, 7, 7, 8, 9]
    import glob

    delta = str(tmp_path / "delta")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), delta, encoding="delta")
    for folder, encoding in ((path, "RLE_DICTIONARY"), (delta, "DELTA_BINARY_PACKED")):
        groups = 0
        for f in glob.glob(f"{folder}/ids/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                assert encoding in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["first"].encodings
                assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
                groups += 1
                assert folder == delta or meta.row_group(g).num_rows <= 30
        assert groups >= (13 if folder == path else 1)
    same = lambda p: sorted((r.start, r.doc_id or 0, r.ids) for r in token_files.token_rows(spark, p).collect())
    assert same(path) == same(delta)


def test_token_files_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "empty")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.with_crc32(token_files.token_rows(spark, path)).collect() == []
    assert token_files.token_range(spark, path, 0, 10).collect() == []
    with pytest.raises(ValueError):
        token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, encoding="plain")
