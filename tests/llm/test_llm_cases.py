"""Brute-force versions of what SQL can't express, repeated ids, clashing names, and the pipeline's stages."""

import hashlib
import itertools
import random
import re
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DATA, SENTENCE, near_brute, odd_docs, shingle_set, words

import corpus_pipeline
from graphloom.llm import chat_format, decontamination, language_id, line_dedup, mixing, near_duplicates, quality_classifier, secret_scan, token_counts
from graphloom.llm.common import discard, written
from graphloom.llm.queries import ACCEPT, quality_model

# secrets: every segmentation -----------------------------------------------------------------------------------------------------------

SHIFTS = {c: (r, k) for r, row in enumerate(secret_scan.ROWS) for k, c in enumerate(row)}


def case_bits(piece):
    ups, downs = sum("A" <= c <= "Z" for c in piece), sum("a" <= c <= "z" for c in piece)
    return 0 if not ups else 1 if not downs or (ups == 1 and "A" <= piece[0] <= "Z") else len(piece)


def price(value, a, b, ranks):
    """Least bits of value[a:b] as one segment that is no brute force."""
    piece, low = value[a:b], value[a:b].lower()
    found = []
    for signs, word in ((0, low), (low != low.translate(secret_scan.LEET), low.translate(secret_scan.LEET))):
        if word in ranks:
            found.append(log2(ranks[word] + 1) + signs + (0 if piece == low else 1 if piece in (low.upper(), low.capitalize()) else len(piece)))
    for form, bits in ((r"(19|20)\d\d", log2(200)), (r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])", log2(2400)), (r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])[-/.]?(0[1-9]|[12]\d|3[01])", log2(73200)), (r"(0[1-9]|[12]\d|3[01])[-/.]?(0[1-9]|1[0-2])[-/.]?(19|20)\d\d", log2(73200))):
        if re.fullmatch(form, piece):
            found.append(bits)
    if len(piece) >= 3:
        if all(c in SHIFTS for c in low):
            ways = [(SHIFTS[y][0] - SHIFTS[x][0], SHIFTS[y][1] - SHIFTS[x][1]) for x, y in itertools.pairwise(low)]
            if all(w != (0, 0) and max(map(abs, w)) == 1 for w in ways):
                found.append(log2(47) + 3 + sum(0.6 if x == y else 3 for x, y in itertools.pairwise(ways)) + case_bits(piece))
        if re.fullmatch("[0-9]+|[a-z]+", low) and len({ord(y) - ord(x) for x, y in itertools.pairwise(low)}) == 1 and abs(ord(low[1]) - ord(low[0])) == 1:
            found.append(log2(36) + 1 + 0.3 * (len(low) - 2) + case_bits(piece))
        if any(value[p : p + len(piece)] == piece for p in range(a)):
            found.append(log2(a) + 0.4 * len(piece))
    return min(found) + 1 if found else float("inf")


def brute_bits(piece):
    kinds = lambda text: sum(n for n, own in ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]"), (33, "[^0-9A-Za-z]")) if re.search(own, text))
    cost = len(piece) * log2(kinds(piece)) + 1
    if "A" <= piece[0] <= "Z":
        cost = min(cost, len(piece) * log2(kinds("a" + piece[1:])) + 2)
    return cost


def least_bits(value, ranks):
    n, inf = len(value), float("inf")
    ends = {0: (0.0, inf)}  # least cost ending in a priced segment, in brute force
    for i in range(1, n + 1):
        ends[i] = (min(min(ends[a]) + price(value, a, i, ranks) for a in range(i)), min(ends[a][0] + brute_bits(value[a:i]) for a in range(i)))
    return min(ends[n])


def test_secret_costs_are_the_least_of_all_segmentations():
    with open(secret_scan.VOCABULARY, "rb") as file:
        ranks = secret_scan.vocabulary_ranks(file.read())
    rng = random.Random(17)
    words_ = [*secret_scan.WORDS, *rng.sample(sorted(ranks), 400)]
    rows = [*secret_scan.ROWS[1:], "zaq", "1qaz", "asdedc"]

    def part():
        kind = rng.randrange(8)
        if kind == 0:
            return rng.choice(words_)
        if kind == 1:
            return rng.choice(words_).translate(str.maketrans("aeios", "@310$"))
        if kind == 2:
            row = rng.choice(rows)
            at = rng.randrange(max(1, len(row) - 3))
            return row[at : at + rng.randrange(2, 7)][:: rng.choice((1, -1))]
        if kind == 3:
            return rng.choice(("20240131", "1999", "31-12-1999", "2001/7", "201512", "12.2020"))
        if kind == 4:
            return rng.choice("abAB19!") * rng.randrange(2, 6)
        if kind == 5:
            return "abcdefghijklmnopqrstuvwxyz0123456789"[(at := rng.randrange(30)) : at + rng.randrange(2, 6)][:: rng.choice((1, -1))]
        return "".join(rng.choices("abzAQR059!$-", k=rng.randrange(1, 5)))

    for _ in range(3000):
        parts = [part() for _ in range(rng.randrange(2, 6))]
        value = "".join([*parts, rng.choice(["", parts[0]])])
        value = rng.choice((value, value.upper(), value.capitalize(), "".join(rng.choice((c, c.upper())) for c in value)))[:24]
        assert secret_scan.guess_bits(value, ranks) == pytest.approx(least_bits(value, ranks)), value
    block = "".join(rng.choices("abcdefgh12345XYZ", k=40))
    assert secret_scan.guess_bits(block + "-" + block) < secret_scan.guess_bits(block) * 1.3  # a copy of 40 characters, one apart
    assert secret_scan.guess_bits("passwordfghj") <= 13.4


# tokens of sections, one by one -----------------------------------------------------------------------------------------------------------


def section_brute(text, sections, rule):
    """Tokens of each section: every character is told its section, every token looks at its own bytes."""
    with open(token_counts.VOCABULARY, "rb") as file:
        encoding, _ = token_counts.encoder(file.read(), token_counts.PATTERN)
    owner = [None] * len(text)
    spans = [(None, None) if s is None else s[1:] for s in sections]
    for k in sorted(range(len(spans)), key=lambda k: (min(max(spans[k][0] or 0, 0), len(text)), k)):
        if None not in spans[k]:
            for c in range(max(spans[k][0], 0), min(spans[k][1], len(text))):
                owner[c] = k if owner[c] is None else owner[c]
    of_byte = [owner[i] for i, c in enumerate(text) for _ in c.encode()]
    tokens, crossing, at = [0] * len(spans), [0] * len(spans), 0
    for token in encoding.encode_ordinary(text):
        own = of_byte[at : at + len(encoding.decode_single_token_bytes(token))]
        at += len(own)
        held = [k for k in own if k is not None]
        home = own[0] if rule == "start" else max(dict.fromkeys(held), key=held.count) if held else None
        if home is not None:
            tokens[home] += 1
            crossing[home] += any(k != home for k in own)
    return list(zip(tokens, crossing, strict=True))


def test_sections_like_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(120):
        text = "".join(rng.choices(["hello ", "there", "naïve ", "12", "\n", "🙂", "internationalisation "], k=rng.randrange(1, 12)))
        bounds = [(rng.randrange(-2, len(text) + 3), rng.randrange(-2, len(text) + 3)) for _ in range(rng.randrange(6))]
        sections = [rng.choice([None, (f"s{k}", None, b), (f"s{k}", a, None)]) if rng.random() < 0.1 else (f"s{k}", a, b) for k, (a, b) in enumerate(bounds)]
        docs.append((i, text, sections))
    df = spark.createDataFrame(docs, "doc_id long, text string, `my.parts` array<struct<name:string,start:long,stop:long>>")
    for rule in token_counts.RULES:
        got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in token_counts.section_token_counts(df, "my.parts", rule).collect()}
        want = {(i, k): x for i, text, sections in docs for k, x in enumerate(section_brute(text, sections, rule))}
        assert got == want
    whole = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing, r.char_start, r.char_end) for r in token_counts.section_token_counts(df).collect()}
    for i, text, _ in docs:
        lines = [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+$", text)]
        want = section_brute(text, [("line", a, b) for a, b in lines], "start")
        assert [whole[i, k] for k in range(len(lines))] == [(*x, a, b) for x, (a, b) in zip(want, lines, strict=True)]


# training bounds, repeated ids ------------------------------------------------------------------------------------------------------------


def test_training_bounds_hold_for_rows(spark, monkeypatch):
    rows = [(1, f"text number {i} of one id", "en" if i % 2 else "de") for i in range(3000)] + [(2 + i, f"eine zeile {i}", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda bags, langs, _real=language_id.train: seen.append(len(bags)) or _real(bags, langs))
    models = [language_id.learn_languages(df, max_train=10) for df in (docs, docs.repartition(3, "text"))]
    assert all(n == 10 for n in seen) and np.array_equal(models[0].table, models[1].table)
    assert language_id.learn_languages(docs.where("doc_id = 1"), max_train=10) is not None and seen[-1] == 1
    sizes = []
    monkeypatch.setattr(quality_classifier, "train", lambda row, col, val, y, _real=quality_classifier.train: sizes.append(len(y)) or _real(row, col, val, y, least_steps=10, epochs=1))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    machines = [quality_classifier.learn_quality(df, labels, ["lang"], max_train=10) for df in (docs, docs.repartition(3, "text"))]
    assert sizes == [10, 10] and np.array_equal(machines[0].linear, machines[1].linear)


def test_language_of_a_long_text_is_that_of_its_pieces(monkeypatch):
    model = language_id.train([language_id.bag(t.encode()) for t in ("the quick brown fox", "der schnelle braune fuchs") * 5], ["en", "de"] * 5)
    long = ("the brown dog and the fox " * 400).encode()
    whole = model.scores([long, b"fuchs", long[:100]])
    monkeypatch.setattr(language_id, "PIECE_BYTES", 100)
    monkeypatch.setattr(language_id.pieces, "__defaults__", (100,))
    assert np.allclose(model.scores([long, b"fuchs", long[:100]]), whole) and len(language_id.pieces([long])[0]) > 90


def test_near_duplicates_of_repeated_ids(spark, monkeypatch):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(0, one), (1, one), (1, two), (2, two), (2, ""), (3, ""), (3, None), (4, "short text"), (4, "short text"), (5, "short text")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (2, 0, False), (2, 0, False), (3, 3, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 4, False)]
    rng = random.Random(8)
    bases = [[f"b{k}w{i}" for i in range(60)] for k in range(8)]
    rows = []
    for _ in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"e{rng.randrange(99)}"
        rows.append((rng.randrange(140), " ".join(text)))
    merged = {}
    for i, t in rows:
        merged.setdefault(i, []).append(t)
    flat = {(i, k): t for i, ts in merged.items() for k, t in enumerate(ts)}
    root = near_brute(flat)
    while True:  # an id's texts are one
        low = {}
        for key, r in root.items():
            low[key[0]] = min(low.get(key[0], r), r)
        moved = {r: low[key[0]] for key, r in root.items() if low[key[0]] < r}
        if not moved:
            break
        root = {key: moved.get(r, r) for key, r in root.items()}
    least = {}
    for (i, _), r in root.items():
        least[r] = min(least.get(r, i), i)
    want = {i: least[r] for (i, _), r in root.items()}
    for pivots, block, salt in (((2, 6), 400, 128), ((1,), 5, 3)):
        monkeypatch.setattr(near_duplicates, "PIVOTS", pivots)
        monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", block)
        monkeypatch.setattr(near_duplicates, "SALT_DOCS", salt)
        found = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want


def test_reply_trees_of_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(40)]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y", None]) and f"t{i}{rng.randrange(9)}", rng.choice([None, 1.0, 2.5, -1.0])) for i in (rng.randrange(40) for _ in range(90))]
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:])
    one = {}
    for r in rows:
        one[r[0]] = min(one.get(r[0], r), r, key=key)
    paths = {}
    for leaf in set(one) - {r[1] for r in one.values() if r[1] in one}:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = one[at][1] if one[at][1] in one else None
        if at is None:
            paths[leaf] = path[::-1]
    ranked = {}
    for leaf in sorted(paths, key=lambda x: (-sum(one[i][4] or 0.0 for i in paths[x]), x)):
        root = paths[leaf][0]
        ranked.setdefault(root, []).append(leaf)
    want = {(root, leaf, k + 1): [(one[i][2] or "", one[i][3] or "") for i in paths[leaf]] for root, leaves in ranked.items() for k, leaf in enumerate(leaves)}
    schema = "id long, parent long, role string, text string, score double, `a.b` int"
    for parts in (1, 5):
        trees = spark.createDataFrame([(*r, 1) for r in rows], schema).repartition(parts)
        got = {(r.root, r.leaf, r.rank): chat_format.read_back(r.conversation)[0] for r in chat_format.format_reply_trees(trees, None).collect()}
        assert got == want and len(want) > 5
    assert chat_format.format_reply_trees(trees.limit(0)).count() == 0
    best = {(r.root, r.leaf) for r in chat_format.format_reply_trees(trees).collect()}
    assert best == {(root, leaf) for root, leaf, k in want if k == 1}
    roots = spark.range(500).selectExpr("id", "cast(null as long) as parent", "'user' as role", "repeat('long ', 20000) as text", "0.0 as score")
    assert chat_format.format_reply_trees(roots.limit(30)).count() == 30


def test_conversations_with_nulls_and_repeated_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "y"), (2, None, "user", "z")]
    trees = chat_format.linear_trees(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, score long"))
    got = {r.root.conv_id: chat_format.read_back(r.conversation)[0] for r in chat_format.format_reply_trees(trees).collect()}
    assert got == {1: [("user", ""), ("user", ""), ("", "x")], None: [("assistant", "y")], 2: [("user", "z")]}


# names, native plans ----------------------------------------------------------------------------------------------------------------------


def test_clashing_names(spark):
    base = odd_docs(spark).select("doc_id", F.col("text").alias("Text"), "source")
    extra = ["host", "keys", "__keys", "__host", "keys_of", "host_of", "done", "__done", "n_dropped", "a.b", "_host_of"]
    docs = base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_dropped"], "n_dropped"] and out.count() == base.count()
    bench = spark.createDataFrame([(1, SENTENCE.format(i=1), "x")], "item_id long, text string, `c.d` string")
    clean = decontamination.decontaminated(base.select("doc_id", F.col("Text").alias("text"), F.lit(1).alias("a.b"), F.lit(2).alias("shingle")), bench)
    assert clean.columns == ["doc_id", "text", "a.b", "shingle"] and {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, None, 8, 9}
    model = quality_classifier.learn_quality(docs, spark.createDataFrame([(5, 1), (4, 0)], "doc_id long, label int"))
    scored = quality_classifier.with_quality(docs, model)
    assert scored.columns == [*docs.columns, "score"] and scored.count() == base.count()
    assert mixing.mixed(docs).count() == base.count()


def test_written_tables_can_be_discarded(spark):
    held = written(spark.range(3).toDF("x"), "held")
    assert held.count() == 3
    discard(held, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)not exist|not_exist|not found"):
        held.count()


# the pipeline -----------------------------------------------------------------------------------------------------------------------------


def lines_brute(rows):
    """Text of each row after lines on more than the ratio of its source's distinct texts are gone, unless none of its words would be left."""
    strip = " \t\n\x0b\x0c\r"
    pages, out = {}, []
    for r in rows:
        pages.setdefault(r.source, set()).add(r.text or "")
    found = {}
    for source, texts in pages.items():
        count = {}
        for t in texts:
            for line in {x.strip(strip) for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        found[source] = {x for x, n in count.items() if n >= line_dedup.MIN_PAGES and n > len(texts) * line_dedup.MAX_RATIO}
    for r in rows:
        left = [x for x in (r.text or "").split("\n") if x.strip(strip) not in found[r.source]]
        out.append(r.text if r.text is None or not any(x.strip(strip) for x in left) else "\n".join(left))
    return out


def mix_brute(rows, block=mixing.BLOCK_TOKENS, passes=mixing.MAX_PASSES, seed=7):
    """(doc_id, taken, text) when every source is one shard: targets by filling up, seats one by one, documents in seeded order."""
    size = {s: sum(len(words(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(passes * size[s] for s in capped)) / max(sum(weight[s] for s in size if s not in capped), 1)
        over = {s for s in size if s not in capped and level * weight[s] > passes * size[s]}
        if not over:
            break
        capped |= over
    target = {s: float(passes * size[s]) if s in capped else level * weight[s] for s in size}
    seats = dict.fromkeys(size, 0)
    block = max(1, min([block, *[int(t // mixing.LEAST_BLOCKS) for t in target.values() if t > 0]]))
    for _ in range(round(total / block)):
        able = [s for s in size if seats[s] < -(-size[s] * passes // block)]
        if able:
            seats[max(able, key=lambda s: (target[s] / (2 * seats[s] + 1), [-ord(c) for c in s or "~"]))] += 1
    out = {}
    for s in size:
        take = min(seats[s] * block, passes * size[s])
        rest = take % max(size[s], 1)
        for r in sorted((r for r in rows if r.source == s), key=lambda r: hashlib.md5(f"{seed}:{r.doc_id}".encode()).hexdigest()):
            own = words(r.text)
            more = min(len(own), rest)
            rest -= more
            k = take // max(size[s], 1) + (more == len(own) and more > 0)
            out[r.doc_id] = (k * len(own) + (more if more < len(own) else 0), "\n".join([r.text] * k + ([" ".join(own[:more])] if 0 < more < len(own) else [])) if own else "")
    return out


def test_pipeline_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = {r.item_id: shingle_set(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA), "test-stage")
        rows = docs.collect()
        before, after = {r.doc_id: r for r in rows}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before), name
        if name == "quality_classifier":
            model = quality_model(spark, docs, DATA)
            each = {r.doc_id: float(model.scores(*quality_classifier.features([(r.text or "").encode()]), 1)[0]) for r in rows}
            assert set(after) == {i for i, score in each.items() if score >= ACCEPT}
        if name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {r.doc_id: t for r, t in zip(rows, lines_brute(rows), strict=True)}
        if name == "minhash_near_dedup":
            assert set(after) == {i for i, c in near_brute({i: r.text for i, r in before.items()}).items() if i == c}
        if name == "benchmark_decontamination":
            assert set(after) == {i for i, r in before.items() if not any(100 * len(shingle_set(r.text) & s) >= 75 * len(s) for s in bench.values())}
        if name == "source_mixing":
            assert {i: (r.taken, r.text) for i, r in after.items()} == mix_brute(rows)
            assert all(len(words(r.text)) == r.taken for r in after.values())
        else:
            assert out.columns == docs.columns
        docs = out
    assert len(after) == len(before) and name == "source_mixing" and any(r.taken > r.size for r in after.values())


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark):
    odd = odd_docs(spark).select("doc_id", "text", F.col("lang"), "source", "n_chars")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert out.count() <= n and (name == "source_mixing" or out.columns == docs.columns), name
    kept = corpus_pipeline.near_dedup(spark, odd, DATA).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 5, 8, 9]
