"""Labels of blank nodes that do not depend on the given ones, by refining colours of nodes; graphs that differ in labels only become equal.

A node's colour is a hash of what is said of it, with the colours of its blank neighbours, to a fixpoint. Nodes whose colour is their own
are settled. The others fall into components, linked through unsettled nodes only; in one whose nodes share colours, each node of a
shared colour is tried as the first, all tries are refined side by side, and those of least certificate are followed further. Components of equal
certificates are copies of each other, so which of them is named first makes no difference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import components
from graphloom.storage import discard, stored

#: Hexadecimal digits of a hash that a sum takes: three such sums stand for a set of any size, whatever its order.
PART = 15


def _is_blank(c: str) -> Column:
    return F.col(c).startswith("_:")


def _set_hash(column: str) -> list[Column]:
    """Aggregates that identify a multiset of hashes: its size and three sums; they combine before a shuffle, so no task holds a set."""
    part = lambda k: F.conv(F.substring(column, 1 + k * PART, PART), 16, 10).cast("decimal(38,0)")
    return [F.count(column).cast("string").alias("n"), *[F.sum(part(k)).cast("string").alias(f"h{k}") for k in range(3)]]


def _sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\x1e")) for p in parts]), 256)


def _bytes(sha: Column) -> Column:
    """Half of a hash, as bytes: what is dealt to tasks, as hexadecimal digits don't compress."""
    return F.unhex(F.substring(sha, 1, 32))


def _key(c: str) -> Column:
    """A node's name as 16 bytes, however long it is."""
    return _bytes(F.sha2(F.col(c), 256))


def _hexed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


def _once(t: DataFrame) -> DataFrame:
    """t without repeated rows. Only 64-bit hashes are dealt to tasks: rows whose hash is not met twice are passed on as they come, the few others are compared."""
    key = F.xxhash64(*t.columns)
    repeated = stored(t.select(key.alias("key")).repartition("key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return t
    keyed = t.withColumn("key", key)
    return keyed.join(repeated, "key", "left_anti").drop("key").unionByName(keyed.join(repeated, "key", "left_semi").drop("key").distinct())


def _sides(t: DataFrame) -> DataFrame:
    """node, said, other, out of t, which has no repeated triples: what is said of each blank node, once from each side; other is the blank node at the other end, and said is the hash of all else."""
    extra = [F.col(c) if c in t.columns else F.lit(None).cast("string") for c in ("o_dt", "o_lang")]
    loop = (F.col("s") == F.col("o")).cast("string")
    out = t.where(_is_blank("s")).select(_key("s").alias("node"), _sha(F.lit("out"), "p", F.when(~F.col("_b"), F.col("o")), F.when(~F.col("_b"), F.col("o_kind")), *extra, F.when(F.col("_b"), loop)).alias("said"), F.when(F.col("_b"), _key("o")).alias("other"), F.lit(True).alias("out"))
    into = t.where(F.col("_b")).select(_key("o").alias("node"), _sha(F.lit("in"), "p", F.when(~_is_blank("s"), F.col("s")), F.when(_is_blank("s"), loop)).alias("said"), F.when(_is_blank("s"), _key("s")).alias("other"), F.lit(False).alias("out"))
    return out.unionByName(into)


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the hashes h of each group, which add up with other sums of it."""
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + k * PART, PART), 16, 10).cast("decimal(38,0)")).alias(f"h{k}")
    return rows.groupBy(*keys).agg(F.count("h").alias("n"), *[part(k) for k in range(3)])


def _refined(colours: DataFrame, fixed: DataFrame, sides: DataFrame) -> DataFrame:
    """try, node, colour to a fixpoint: (try, node, colour), the sums of sides that no round changes (try, node, n, h0, h1, h2), and the others (try, node, said, other).

    A round replaces a colour by a hash of it and of all sides; it ends when no try gains a colour.
    """
    held = stored(colours, "colours")
    count = held.select("try", "colour").distinct().count()
    while True:
        own = sides.join(held.select("try", F.col("node").alias("other"), F.col("colour").alias("beside")), ["try", "other"], "left")
        moving = _summed(own.select("try", "node", _sha("said", "beside").alias("h")), "try", "node")
        sums = moving.unionByName(fixed).groupBy("try", "node").agg(*[F.sum(c).cast("string").alias(c) for c in ("n", "h0", "h1", "h2")])
        after = held.join(sums, ["try", "node"], "left").select("try", "node", _sha("colour", "n", "h0", "h1", "h2").alias("colour"))
        after = stored(after, "colours")
        discard(held)
        held, more = after, after.select("try", "colour").distinct().count()
        if more == count:
            return held
        count = more


def canonical(t: DataFrame) -> DataFrame:
    """t with labels _:c<hash> (and a number, for copies) for its blank nodes: graphs that are equal but for labels get the same triples, others do not.

    t: s, p, o, o_kind and, if there, o_dt and o_lang; a blank node is a subject that starts with _:, or an object that does and is no literal. Other columns
    go. Repeated triples become one. Each round and each choice is a step over all unsettled nodes together; a component in which
    many nodes stay alike after many choices (a large regular graph of blank nodes) takes a try for each way to order them.
    """
    return relabelled(t).distinct()


def _marked(t: DataFrame) -> DataFrame:
    """The columns of t that make a triple, and _b: whether its object is a blank node."""
    columns = [c for c in ("s", "p", "o", "o_kind", "o_dt", "o_lang") if c in t.columns]
    return t.select(*columns).withColumn("_b", F.coalesce(_is_blank("o") & (F.col("o_kind") != "lit"), F.lit(False)))


def _labels(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, fixed, moving) of marked triples, none repeated: (node, label), the sums of sides without a blank node at the other end (node, x0, x1, n), and the other sides.

    Sides without a blank node at the other end, most in usual graphs, are summed once, and as none is repeated, by exclusive or, which takes two numbers. A node
    whose sums are its own is settled by them. Only the others' sides are looked at in rounds.
    """
    sides = _sides(own)
    moving = stored(sides.where("other is not null").select("node", F.unhex("said").alias("said"), "other", "out"), "moving")
    part = lambda k: F.bit_xor(F.coalesce(F.conv(F.substring("said", 1 + k * PART, PART), 16, 10).cast("long"), F.lit(0))).alias(f"x{k}")
    ends = moving.select("node", F.lit(None).cast("string").alias("said"))  # so that nodes without such a side have a row too
    fixed = stored(sides.where("other is null").select("node", "said").unionByName(ends).groupBy("node").agg(part(0), part(1), F.count("said").alias("n")), "fixed")
    first = fixed.select("node", _bytes(_sha(*[F.col(c).cast("string") for c in ("n", "x0", "x1")])).alias("colour"))
    shared = stored(first.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour"), "shared")
    settled, open_ = first, None
    if not shared.isEmpty():
        settled, open_ = stored(first.join(shared, "colour", "left_anti").select("node", "colour"), "settled"), stored(first.join(shared, "colour", "left_semi").select("node", "colour"), "open")
    labels = settled.select("node", F.lower(F.hex("colour")).alias("colour"))
    if open_ is not None:
        labels = labels.unionByName(_opened(open_, settled, moving))
    labels = stored(labels.select("node", F.concat(F.lit("_:c"), "colour").alias("label")), "labels")
    discard(shared, *([settled, open_] if open_ is not None else []))
    return labels, fixed, moving


def _opened(open_: DataFrame, settled: DataFrame, moving: DataFrame) -> DataFrame:
    """node, colour (in digits) of nodes that share their colours, each its own: refined by their links with settled nodes and each other, then by choices."""
    own = stored(_hexed(moving.join(open_.select("node"), "node", "left_semi"), "said").select("node", "said", "other"), "sides")
    near = settled.join(own.select(F.col("other").alias("node")).distinct(), "node", "left_semi")
    known = stored(_hexed(near, "node", "colour"), "known")
    sides, alike = _hexed(own, "node", "other"), _hexed(open_, "node", "colour")
    met = sides.join(known.select(F.col("node").alias("other"), F.col("colour").alias("beside")), "other", "left")
    # what a node's own sums say is in its first colour
    fixed = stored(_summed(met.where("beside is not null").select("node", _sha("said", "beside").alias("h")), "node"), "fixed")
    local = stored(met.where("beside is null").select("node", "said", "other"), "moving")
    of = lambda df: df.select(F.lit("").alias("try"), "*")
    first = _refined(of(alike), of(fixed), of(local))
    named = stored(first.select("node", "colour", F.count("*").over(Window.partitionBy("colour")).alias("n")), "named")
    found, left = named.where("n = 1").select("node", "colour"), named.where("n > 1").select("node", "colour")
    if not left.isEmpty():
        found = found.unionByName(_settled_components(left, found, fixed, local))
    return found.select(F.unhex("node").alias("node"), "colour")


def relabelled(t: DataFrame) -> DataFrame:
    """The triples of canonical as a bag, for what drops repeated ones itself.

    Only triples of blank nodes are dealt to tasks; what names none is passed on as it comes.
    """
    own = _marked(t)
    columns = [c for c in own.columns if c != "_b"]
    labels, fixed, moving = _labels(_once(own.where(_is_blank("s") | F.col("_b"))))
    to = lambda c: labels.select(F.col("node").alias("_key"), F.col("label").alias(f"_{c}"))
    plain = own.where(~F.coalesce(_is_blank("s"), F.lit(False)))
    after = own.where(_is_blank("s")).withColumn("_key", _key("s")).join(to("s"), "_key", "left").withColumn("s", F.coalesce("_s", "s")).select(*columns, "_b").unionByName(plain.where("_b").select(*columns, "_b"))
    named_o = after.where("_b").withColumn("_key", _key("o")).join(to("o"), "_key", "left").withColumn("o", F.coalesce("_o", "o"))
    discard(fixed, moving)
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (named_o, after.where("not _b"), plain.where("not _b"))])


def sums(t: DataFrame) -> DataFrame:
    """One row, n and three sums that identify t as canonical gives it, whatever its order, labels and repeats; sums of graphs that share no triple and no blank node add up.

    What canonical says of a node is its label with the sums of its sides, and its links with other blank nodes, so no relabelled triple is made or dealt; a line without a
    blank node is hashed where it is read.
    """
    own = _marked(t)
    columns = [c for c in own.columns if c != "_b"]
    blank = F.coalesce(_is_blank("s"), F.lit(False)) | F.col("_b")
    labels, fixed, moving = _labels(_once(own.where(blank)))
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    links = moving.where("out").join(label("node"), "node").join(label("other"), "other")
    parts = [
        _once(own.where(~blank).select(*columns)).select(_sha(F.lit("line"), *columns).alias("h"), F.lit(1).cast("long").alias("count")),
        fixed.join(label("node"), "node").select(_sha(F.lit("node"), "_node", *[F.col(c).cast("string") for c in ("n", "x0", "x1")]).alias("h"), F.col("n").alias("count")),
        links.select(_sha(F.lit("link"), "_node", F.hex("said"), "_other").alias("h"), F.lit(1).cast("long").alias("count")),
    ]
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + k * PART, PART), 16, 10).cast("long").cast("decimal(38,0)"))
    return stored(reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), *[F.coalesce(part(k), F.lit(0)).cast("decimal(38,0)").alias(f"h{k}") for k in range(3)]), "sums")


def digest(*parts: DataFrame) -> DataFrame:
    """One row, n and digest, of the sums of the parts of a graph."""
    total = reduce(DataFrame.unionByName, parts).agg(*[F.sum(c).alias(c) for c in ("n", "h0", "h1", "h2")])
    return total.select("n", _sha(*[F.col(c).cast("string") for c in ("n", "h0", "h1", "h2")]).alias("digest"))


def _settled_components(open_: DataFrame, settled: DataFrame, fixed: DataFrame, sides: DataFrame) -> DataFrame:
    """node, colour of unsettled nodes, each its own: the certificate of its component, its place among copies, and its colour there."""
    inner = sides.join(open_.select("node"), "node", "left_semi").join(settled.select(F.col("node").alias("other"), F.col("colour").alias("known")), "other", "left")
    known = _summed(inner.where("known is not null").select("node", _sha("said", "known").alias("h")), "node")
    still = stored(known.unionByName(fixed.join(open_.select("node"), "node", "left_semi")).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "h0", "h1", "h2")]), "still")
    local = stored(inner.where("known is null").select("node", "said", "other"), "local")
    links = local.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    grouped = open_.select("node").join(components(links), "node", "left") if not links.isEmpty() else open_.select("node", F.lit(None).cast("string").alias("component"))
    part = stored(grouped.select("node", F.coalesce("component", "node").alias("part")), "parts")
    # a try is a part with the choices made so far
    tries = stored(open_.join(part, "node").select(F.col("part").alias("try"), "part", "node", "colour"), "tries")
    while True:
        of = Window.partitionBy("try", "colour")
        counted = tries.withColumn("alike", F.count("*").over(of))
        shared = counted.where("alike > 1")
        chosen = stored(shared.groupBy("try").agg(F.min(F.struct("alike", "colour")).alias("x")).select("try", F.col("x.colour").alias("chosen")), "chosen")
        if chosen.isEmpty():
            break
        more = tries.join(chosen, "try").where("colour = chosen").select("try", F.col("node").alias("first"))
        split = tries.join(more, "try").select(F.sha2(F.concat_ws("\x1f", "try", "first"), 256).alias("try"), "part", "node", F.when(F.col("node") == F.col("first"), _sha(F.lit("first"), "colour")).otherwise(F.col("colour")).alias("colour"))
        split = stored(split, "split")
        refined = _refined(split.select("try", "node", "colour"), *[split.select("try", "node").join(x, "node") for x in (still, local)])
        new = refined.join(split.select("try", "node", "part"), ["try", "node"])
        done = tries.join(chosen, "try", "left_anti")
        all_ = stored(new.select("try", "part", "node", "colour").unionByName(done.select("try", "part", "node", "colour")), "tries")
        tries = stored(_least_tries(all_), "tries")
        discard(split, all_)
    best = _least_tries(tries, one=True)
    marks = best.groupBy("part").agg(*_set_hash("colour")).select("part", _sha("n", "h0", "h1", "h2").alias("mark"))
    copies = marks.withColumn("copy", F.row_number().over(Window.partitionBy("mark").orderBy("part")))
    return best.join(copies, "part").select("node", F.concat(_sha("mark", "colour"), F.lit("n"), F.col("copy").cast("string")).alias("colour"))


def _least_tries(tries: DataFrame, one: bool = False) -> DataFrame:
    """The tries of each part whose certificate, the set of their colours, is least; one of them if asked."""
    marks = tries.groupBy("part", "try").agg(*_set_hash("colour")).select("part", "try", _sha("n", "h0", "h1", "h2").alias("mark"))
    least = marks.groupBy("part").agg(F.min("mark").alias("mark"))
    kept = marks.join(least, ["part", "mark"])
    kept = kept.groupBy("part").agg(F.min("try").alias("try")) if one else kept.select("part", "try")
    return tries.join(kept, ["part", "try"], "left_semi")


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs are equal but for the labels of blank nodes."""
    one, two = canonical(a), canonical(b)
    names = reduce(lambda x, y: x if len(x) >= len(y) else y, [one.columns, two.columns])
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])
    return full(one).exceptAll(full(two)).isEmpty() and full(two).exceptAll(full(one)).isEmpty()
