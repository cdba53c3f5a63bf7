"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketching: in round r every shingle is hashed to one bin with a value; a bin holds the least
(round, value) pair. After ``COORDINATES`` free rounds, round ``COORDINATES + j`` sends every
shingle to bin j, so every coordinate of a non-empty set fills after at most twice that many rounds;
a set with many shingles fills after one or two. A coordinate agrees between two sets with the
probability of their Jaccard similarity, with concentration as for independent permutations.

Search: documents with equal sets form a class, a node of the graph of links. Bands of the sketch key
buckets. In a bucket all pairs are decided in the order of their smaller node, in a few
rounds: pairs with the first members first, then, only between nodes that the links so far leave
in different components, with the next ones. So most of a bucket full of near copies is joined
after a few comparisons a member. Members of a large bucket are dealt over salts, and its first members copied to each,
so that no bucket is one task's. The pairs left, between texts outside a bucket's main component and
the rest, are decided block against block, each pair in the first band that it shares, so that no
pair that could join two components is skipped and none becomes a row. An id that several texts have links their classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, prepared, written
from graphloom.llm.vectext import U64, mix, shingle_sets

ROWS_PER_BAND = 4
#: At similarity 0.75 a pair shares none of 36 bands with probability (1 - 0.75**4)**36 = 1e-6, above it with less.
BANDS = 36
COORDINATES = ROWS_PER_BAND * BANDS
#: Members by order in their bucket whose pairs are decided in each round, before blocks take the others.
PIVOTS = (2, 6)
#: Members of a bucket that meet its first members in one task, about.
SALT_DOCS = 128
#: A block of the last round holds about so many documents and so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 400, 200_000
OF_CLASS = ["n_shingles", "digest_a", "digest_b"]
SKETCH_SCHEMA = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def sketch(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty array of distinct 64-bit hashes."""
    bins = np.full(coordinates, np.iinfo(np.uint64).max, dtype=U64)
    at_once = max(1, min(coordinates, 2 * coordinates // len(shingles)))
    r = 0
    while r < 2 * coordinates:
        rounds = np.arange(r, min(r + at_once, coordinates) if r < coordinates else r + 1, dtype=U64)
        hashed = mix(shingles[None, :] + (rounds[:, None] + U64(1)) * U64(0x9FB21C651E98DF25))
        values = (rounds[:, None] << U64(48)) | (hashed >> U64(16))
        if r < coordinates:
            places = ((mix(hashed ^ U64(0xD1B54A32D192ED03)) >> U64(32)) * U64(coordinates)) >> U64(32)
            np.minimum.at(bins, places.astype(np.int64).ravel(), values.ravel())
        else:
            bins[r - coordinates] = min(bins[r - coordinates], values.min())
        r += len(rounds)
        if bins.max() != np.iinfo(np.uint64).max:
            break
    return bins


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One key for each band of each sketch (documents x bands)."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS_PER_BAND)
    keys = np.broadcast_to(np.arange(BANDS, dtype=U64) * U64(0xA24BAED4963EE407), parts.shape[:2]).copy()
    for k in range(ROWS_PER_BAND):
        keys = mix(keys + parts[:, :, k])
    return keys.view(np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers; 0 for an empty one."""
    both = [mix(shingles).sum(dtype=U64), mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)] if len(shingles) else [0, 0]
    a, b = np.array(both, dtype=U64).view(np.int64).tolist()
    return a, b


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, digests, keyed, sketches = batch.column(0), [], [], [], []
        for s in shingle_sets(_encoded(batch.column(1))):
            sizes.append(len(s))
            digests.append(_digests(s))
            keyed.append(len(s) > 0)
            if len(s):
                sketches.append(sketch(s))
        flat = band_keys(np.stack(sketches)).ravel() if sketches else np.zeros(0, dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(np.where(np.array(keyed, dtype=bool), BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))
        two = [pa.array([d[k] for d in digests], pa.int64()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *two, bands], ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, text, digest_a, digest_b) the sets of texts with those digests: an id may have other texts too."""
    for batch in batches:
        wanted = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        sets = [(node, s) for node, s, own in zip(batch.column(0).to_pylist(), shingle_sets(_encoded(batch.column(1))), wanted, strict=True) if _digests(s) == own]
        stops = np.concatenate([[0], np.cumsum([len(s) for _, s in sets])]).astype(np.int32)
        flat = np.concatenate([*(s for _, s in sets), np.zeros(0, dtype=U64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))], ["node", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, root), root being the component's least node.

    Each round every node follows its neighbour of least order, where that is below its own, and the
    links between the followed nodes remain. The order is the number itself at first and a new hash in
    each later round, which shrinks any graph, chains included, by a constant factor on average.
    Nothing but an emptiness test reaches the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    k, used = 0, [edges]
    while not edges.isEmpty():
        order = lambda c, k=k: F.struct((F.xxhash64(c, F.lit(k)) if k else c).alias("h"), c.alias("v"))
        step = edges.groupBy("a").agg(F.min(order(F.col("b"))).alias("least"))
        step = step.select("a", F.least("least", order(F.col("a")))["v"].alias("to"))
        step = written(step, "step")
        used += [step, roots]
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(step, roots["root"] == step["a"], "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = written(roots, "roots")
        other = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = written(edges.join(step, "a").join(other, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        used.append(edges)
        k += 1
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = roots.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least"))
    out = written(roots.join(least, "root").select("node", F.col("least").alias("root")), "components")
    discard(*used, roots)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets share percent of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")).cast("long"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.where(F.col("shared") * 100 >= union * percent).select("a", "b")


def _rooted(df: DataFrame, column: str, roots: DataFrame | None) -> DataFrame:
    """df with the root of a column's nodes as root_<column>."""
    if roots is None:
        return df.withColumn(f"root_{column}", F.col(column))
    named = roots.select(F.col("node").alias(column), F.col("root").alias(f"root_{column}"))
    return df.join(named, column, "left").withColumn(f"root_{column}", F.coalesce(f"root_{column}", column))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The roots after further links (a, b)."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    between = _rooted(_rooted(links, "a", roots), "b", roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    merged = components(between)
    moved = _rooted(roots, "root", merged).select("node", F.col("root_root").alias("root"))
    fresh = merged.join(roots.select("node"), "node", "left_anti")
    return written(moved.union(fresh), "roots")


def _block_links(rest: DataFrame, roots: DataFrame | None, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rest's bucket members of different components.

    Of any such pair one side is outside the bucket's most frequent component, so blocks of those meet
    blocks of all members. A bucket has as many blocks as its members' number and size ask for; pairs of blocks are
    dealt by bucket and block, so a bucket's pairs spread over tasks.
    """
    rest = _rooted(rest, "node", roots).withColumnRenamed("root_node", "root")
    by_root = rest.groupBy("key", "root").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    buckets = by_root.groupBy("key").agg(F.max_by("root", F.struct("docs", "root")).alias("main"), F.count("*").alias("roots"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).where("roots > 1")
    count = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES))
    # written, so that the join below reads both sides as they are and adaptive execution can split a hot bucket
    buckets = written(buckets.select("key", "main", count.alias("blocks")), "buckets")
    mixed = rest.join(buckets, "key")
    mixed = written(mixed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "mixed")
    whole = mixed.join(classes.select("node", "bands"), "node").join(sets, "node")
    parts = ("node", "root", "bands", "shingles")

    def blocks(df: DataFrame, side: str) -> DataFrame:
        held = df.groupBy("key", "block").agg(*[F.collect_list(c).alias(f"{side}_{c}") for c in parts])
        return held.withColumnRenamed("block", f"{side}_block")

    pairs = mixed.where("root <> main").select("key", "main", F.col("block").alias("l_block"), "blocks").distinct()
    pairs = pairs.select("key", "main", "l_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("r_block"))
    met = pairs.join(blocks(whole.where("root <> main"), "l"), ["key", "l_block"]).join(blocks(whole, "r"), ["key", "r_block"])
    links = written(met.mapInPandas(_block_pairs(percent), "a long, b long").distinct(), "links")
    discard(mixed, buckets)
    return links


def _block_pairs(percent: int):
    def run(frames):
        for frame in frames:
            found: list[tuple[int, int]] = []
            for row in frame.itertuples(index=False):
                found += _links_of_blocks(row, percent)
            yield pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def _links_of_blocks(row, percent: int) -> list[tuple[int, int]]:
    """The linked pairs of one block of documents outside the main component with a block of any."""
    ids, roots = np.asarray(row.r_node), np.asarray(row.r_root)
    bands = np.stack(row.r_bands)
    sizes = np.array([len(s) for s in row.r_shingles])
    values = np.concatenate(row.r_shingles)
    owners = np.repeat(np.arange(len(ids)), sizes)
    found = []
    for doc, root, own_bands, own in zip(row.l_node, row.l_root, row.l_bands, row.l_shingles, strict=True):
        able = (roots != root) & ((roots == row.main) | (ids > doc))
        able &= np.minimum(sizes, len(own)) * 100 >= np.maximum(sizes, len(own)) * percent
        same = bands == own_bands[None, :]
        able &= own_bands[same.argmax(axis=1)] == row.key
        if not able.any():
            continue
        own = np.sort(own)
        pick = np.flatnonzero(able[owners]) if able.mean() < 0.9 else slice(None)
        tested = values[pick]
        hit = own[np.minimum(np.searchsorted(own, tested), len(own) - 1)] == tested
        shared = np.bincount(owners[pick][hit], minlength=len(ids))
        linked = able & (shared * 100 >= (sizes + len(own) - shared) * percent)
        found += [(int(doc), int(x)) for x in ids[linked]]
    return found


def _shared_id_links(filled: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that have texts in several."""
    own = filled.join(repeated.select("doc_id"), "doc_id", "left_semi").select("doc_id", *OF_CLASS).distinct()
    nodes = own.join(classes.select("node", *OF_CLASS), OF_CLASS).select("doc_id", "node")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return nodes.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _components_of_classes(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """classes with component_id, the least document of all classes linked with one."""
    own = classes.select(*OF_CLASS, "node", "rep")
    if roots is None:
        return own.withColumn("component_id", F.col("rep"))
    linked = roots.join(own.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = roots.join(least, "root").select("node", "component_id")
    return own.join(moved, "node", "left").withColumn("component_id", F.coalesce("component_id", "rep"))


def near_duplicate_classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Near-duplicate class of every document: doc_id, n_shingles, component_id, kept.

    docs: doc_id (integer) and text; other columns are ignored, whatever their names. Texts are lower-cased (A-Z) and cut to
    words; a document's set holds its distinct 5-word shingles, its whole sequence if it has fewer
    words, and nothing for an empty or null text, which is linked with nothing. Two documents are linked
    if 100 * shared >= percent * union, confirmed on full sets (64-bit hashes of shingles);
    component_id is the least doc_id reachable, kept means doc_id = component_id. A row with a null
    doc_id is linked with nothing, has a null component_id and is kept. Rows that repeat a doc_id are
    returned each, with their own n_shingles; their texts count as texts of that one id, whose component holds what any of them is linked with.
    A very long text is taken whole. An empty table gives an empty result.
    percent must be 75 or more: the bands are laid out for that.
    """
    if percent < 75:
        raise ValueError("the bands find pairs of similarity 0.75 and above")
    spark = docs.sparkSession
    prepared(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(texts.mapInArrow(_sketch_batches, SKETCH_SCHEMA), "sketches")

    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*OF_CLASS).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))  # equal sets have equal bands
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    set_of = F.struct(*OF_CLASS)
    repeated = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(set_of).alias("low"), F.max(set_of).alias("high"))
    repeated = written(repeated.where("n > 1").select("doc_id", (F.col("low") != F.col("high")).alias("several")), "repeated")
    unique = repeated.isEmpty()
    several = repeated.where("several")

    keyed = classes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").cast("int").alias("n"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).where("least < most")
    buckets = written(buckets.select("key", F.ceil(F.col("size") / SALT_DOCS).alias("salts")), "buckets")
    members = written(keyed.join(buckets, "key").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))), "members")
    order = Window.partitionBy("key").orderBy("node")
    # the bare rank is compared, so that Spark keeps the first members of a bucket before it shuffles
    firsts = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS[-1])
    firsts = written(firsts, "firsts")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "node", "digest_a", "digest_b")
    sets = texts.join(wanted, "doc_id").select("node", "text", "digest_a", "digest_b").mapInArrow(_set_batches, "node long, shingles array<long>")
    sets = written(sets if unique else sets.dropDuplicates(["node"]), "sets")

    used = [buckets, members, firsts, sets, repeated, classes]
    roots, begin = None, 0
    if not unique:
        roots = _joined(roots, written(_shared_id_links(filled, classes, several), "links"))
    for end in PIVOTS:
        left = firsts.where((F.col("rank") > begin) & (F.col("rank") <= end)).select("key", "salts", F.col("node").alias("a"), F.col("n").alias("n_a"))
        left = _rooted(left, "a", roots).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        right = members.select("key", "salt", F.col("node").alias("b"), F.col("n").alias("n_b"))
        met = left.join(_rooted(right, "b", roots), ["key", "salt"]).where("a < b and root_a <> root_b")
        met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        pairs = written(met.select("a", "b").distinct(), "pairs")
        links = written(_verified(pairs, sets, percent), "links")
        used += [pairs, links, roots]
        roots = _joined(roots, links)
        begin = end
    rest = members.join(firsts.select("key", "node"), ["key", "node"], "left_anti")
    if not rest.isEmpty():
        links = _block_links(rest, roots, sets, classes, percent)
        used += [links, roots]
        roots = _joined(roots, links)

    placed = written(_components_of_classes(classes, roots), "placed")
    out = sketched.select("doc_id", *OF_CLASS).join(placed.select(*OF_CLASS, "component_id"), OF_CLASS, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not unique:
        least = out.join(several.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(written(least, "least"), "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    discard(*{id(t): t for t in [*used, roots] if t is not None}.values())
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
