"""From tables to instances: keys of rows, classes and properties of foreign keys, promoted dimensions, injected properties, and what is lost on the way.

Names of tables, columns, classes and properties are a schema's, few by nature; they are resolved on the driver or in small tables. Rows stay in plans.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.coercion import safe_iri, safe_local, to_number, to_timestamp, without_sentinel
from graphloom.operators.reasoning import superclasses

#: Name ends of keys and of audit columns, which make keys last.
KEY_ENDS, AUDIT_ENDS = ("id", "code"), ("object_id", "program_id", "transaction_id", "wip_entity_id", "archived_employee_num")
#: Names of time columns, and name ends of classes that their id column lacks.
TIME_COLUMNS = (
    "timestamp", "datetime", "measurementdatetime", "testdatetime", "occurrencedatetime",
    "departuretime", "generationdate", "maintenancedate", "orderdate", "plandate",
)
CLASS_ENDS = (
    "master", "map", "history", "results", "events", "data", "status",
    "quality", "plan", "result", "monitoring", "management", "transaction",
)


def explicit_key(columns: list[str], wanted: list[str]) -> list[str] | None:
    """The configured key columns, only if the table has all of them, in any case."""
    held = {c.lower(): c for c in columns}
    return [held[w.lower()] for w in wanted] if wanted and all(w.lower() in held for w in wanted) else None


def key_candidates(columns: list[str], c: str, suffixes: tuple[str, ...] = ("master", "info", "type")) -> list[str]:
    """Columns that may name instances of a class, in order: its name without a suffix and id; its name and id or code; all that end so. Audit columns come last."""
    held, name = {x.lower(): x for x in columns}, c.lower()
    bases = [name[: -len(s)] for s in suffixes if name.endswith(s) and len(name) > len(s)]
    asked = [f"{b}id" for b in bases] + [f"{name}{e}" for e in KEY_ENDS] + [x for x in held if x.endswith(KEY_ENDS)]
    found = [held[x] for x in dict.fromkeys(asked) if x in held]
    return sorted(found, key=lambda x: x.lower().endswith(AUDIT_ENDS))


def detected_key(df: DataFrame, c: str, suffixes: tuple[str, ...] = ("master", "info", "type")) -> str | None:
    """The candidate with the largest share of distinct non-empty values, the first on ties; one aggregation over all rows."""
    names = key_candidates(df.columns, c, suffixes)
    if not names:
        return None
    row = df.agg(*[F.count_distinct(F.nullif(F.trim(F.col(x).cast("string")), F.lit(""))).alias(f"c{k}") for k, x in enumerate(names)]).first()
    return names[max(range(len(names)), key=lambda k: (row[f"c{k}"], -k))]


def _told(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def row_time(columns: list[str]) -> Column | None:
    """The time of a row: the first named time column that it fills, else the first column with date or time in its name that holds 10 characters or more."""
    held = {c.lower(): c for c in columns}
    named = [safe_local(_told(held[c])) for c in TIME_COLUMNS if c in held]
    like = [_told(c) for low, c in held.items() if "date" in low or "time" in low]
    found = named + [F.when(F.length(c) >= 10, safe_local(c)) for c in like]
    return F.coalesce(*found) if found else None


def row_key(key: str | list[str] | None, authoritative: bool = False, time: str | None = None, c: str | None = None, columns: list[str] | None = None) -> Column:
    """The local name of a row: its key's parts made safe and joined by _.

    Where the key is not given, or a row lacks a part of it, the name falls back, given the table's columns: to the id column of the class c without
    its suffix (FooMaster: fooid), then to the first id or code column that the row fills; null if there is none. The time is added to a
    composite key and to a fallback, unless the key is authoritative, holds a time itself, or the row has none; it is the column time, or
    else found by row_time in the columns.
    """
    parts = [key] if isinstance(key, str) else key or []
    told = [_told(x) for x in parts]
    own = F.when(F.forall(F.array(*told), lambda x: x.isNotNull()), F.concat_ws("_", *[safe_local(x) for x in told])) if told else F.lit(None).cast("string")
    held = {x.lower(): x for x in columns or []}
    bases = [c.lower()[: -len(end)] for end in CLASS_ENDS if c and c.lower().endswith(end)][:1]
    names = [f"{b}id" for b in bases if b and f"{b}id" in held] + [x for x in held if x.endswith(KEY_ENDS)]
    fallback = F.coalesce(*[safe_local(_told(held[x])) for x in names]) if names else F.lit(None).cast("string")
    at = safe_local(_told(time)) if time else row_time(columns or [])
    timed = lambda name: name if authoritative or at is None else F.when(name.isNotNull(), F.concat_ws("_", name, at))
    holds = any(x.lower() in TIME_COLUMNS or "timestamp" in x.lower() or "datetime" in x.lower() for x in parts)
    return F.coalesce(own if isinstance(key, str) or holds else timed(own), timed(fallback))


def fk_class(column: str, patterns: dict[str, str], ends: dict[str, str]) -> str | None:
    """The class that a foreign key's column names: by its exact pattern, by a suffix (end: template with {base}), the same without - and ., then without _."""
    name = column.lower()

    def by_end(x: str) -> str | None:
        hits = [e for e in ends if x.endswith(e) and len(x) > len(e)]
        return ends[hits[0]].format(base="".join(w.capitalize() for w in x[: -len(hits[0])].split("_"))) if hits else None

    plain = name.replace("-", "").replace(".", "")
    return patterns.get(name) or by_end(name) or (plain != name and (patterns.get(plain) or by_end(plain))) or by_end(plain.replace("_", "")) or None


def is_fk(column: str, patterns: dict[str, str]) -> bool:
    """Whether a column may be a foreign key: declared, or named so."""
    return column.lower() in patterns or column.lower().endswith(KEY_ENDS)


def _directions(name: str, words: tuple[tuple[str, ...], ...]) -> set[int]:
    told = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
    return {k for k, axis in enumerate(words) if told & set(axis)}


def fk_property(source: str, target: str, column: str, properties: DataFrame, subclass: DataFrame, restricted: list[str] | None = None, directions: tuple[tuple[str, ...], ...] = (("origin", "from", "source"), ("destination", "to", "target"))) -> str | None:
    """The object property (properties: p, domain, range) that a foreign key from one class to another stands for.

    Its range must be the target or above it, its domain the source, above it, or empty. 10 for one that the class restricts, 2 for its own domain, 1 for
    one above; a property that names the other direction than the column is out; the least name wins ties. A schema's tables are small.
    """
    up = superclasses(subclass)
    above = lambda c: {r.b for r in up.where(F.col("a") == c).collect()}  # noqa: E731 (a class's superclasses)
    own, of_target, ways = above(source), above(target) | {target}, _directions(column, directions)
    scored = []
    for r in properties.where(F.col("range").isin(sorted(of_target))).collect():
        if r.domain not in (None, "Thing", source) and r.domain not in own:
            continue
        named = _directions(r.p, directions)
        if not ways or not named or ways & named:
            scored.append((-(10 * (r.p in (restricted or [])) + (2 if r.domain == source else 1 if r.domain in own else 0) + (5 if ways & named else 0)), r.p))
    return min(scored)[1] if scored else None


def fk_value(column: Column, strip_last: int = 0) -> Column:
    """A foreign key's value without its last characters, where it has more."""
    return F.when(F.length(column) > strip_last, F.left(column, F.length(column) - strip_last)).otherwise(column)


def resolve_report(edges: DataFrame, master: DataFrame) -> DataFrame:
    """p, n_resolved, n_unresolved of edges (s, p, o) by whether their target is a master node (node)."""
    known = master.select(F.col("node").alias("o"), F.lit(True).alias("hit")).distinct()
    return edges.join(known, "o", "left").groupBy("p").agg(F.count("hit").alias("n_resolved"), F.count_if(F.col("hit").isNull()).alias("n_unresolved"))


def promoted(edges: DataFrame, master: DataFrame, c: str) -> DataFrame:
    """Triples (s, p, o) of unverified edges whose target is a master node after all: the edge, and the target's type; others add nothing."""
    kept = edges.join(master.select(F.col("node").alias("o")), "o", "left_semi").select("s", "p", "o")
    return kept.unionByName(kept.select(F.col("o").alias("s"), F.lit("type").alias("p"), F.lit(c).alias("o"))).distinct()


def promoted_dimension(df: DataFrame, instance: Column, column: str, c: str, forward: str, backward: str | None = None, label: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Triples (s, p, o) that make a column's distinct codes instances of a class: their types, labels (code, label) if given, and edges both ways."""
    code = F.trim(F.col(column).cast("string"))
    rows = df.where(F.length(code) > 0).select(instance.alias("s"), code.alias("code"), F.concat(F.lit(f"{c}_"), safe_iri(code)).alias("o"))
    codes = rows.select("code", "o").distinct()
    parts = [codes.select(F.col("o").alias("s"), F.lit("type").alias("p"), F.lit(c).alias("o")), rows.where("s is not null").select("s", F.lit(forward).alias("p"), "o")]
    if backward:
        parts.append(rows.where("s is not null").select(F.col("o").alias("s"), F.lit(backward).alias("p"), F.col("s").alias("o")))
    if label and labels is not None:
        parts.append(codes.join(labels, "code").select(F.col("o").alias("s"), F.lit(label).alias("p"), F.col("label").alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def injected_properties(columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """p, domain, column of properties for columns (c, column) that no property maps (c, column): the class's name and the column's in camel case."""
    camel = F.replace(F.initcap(F.translate("column", "_-.", "   ")), F.lit(" "), F.lit(""))
    head = F.concat(F.lower(F.left("c", F.lit(1))), F.substring("c", 2, 200))
    return columns.join(mapped, ["c", "column"], "left_anti").select(F.concat(head, camel).alias("p"), F.col("c").alias("domain"), "column")


def mapped_properties(columns: DataFrame, properties: DataFrame, subclass: DataFrame) -> DataFrame:
    """c, column, p, rank of the property that each column (c, column) is read as: 1 declared for its class, 2 for none, 3 for a class above it, each by source column;
    then 4 by the whole name, in any case and without separators, if the property's domain is the class, above it or none. properties: p, domain, source. The least p wins ties.
    """
    up = superclasses(subclass).select(F.col("a").alias("c"), F.col("b").alias("domain"))
    flat = lambda c: F.lower(F.translate(c, "_-. ", ""))
    near = up.select("c", F.col("domain").alias("above"))
    own = columns.select("c", "column", flat("column").alias("flat")).distinct()
    named = lambda c, by_source: properties.select("p", "domain", flat(c).alias("flat"), F.lit(by_source).alias("by_source"))
    met = own.join(named("source", True).unionByName(named("p", False)), "flat")
    met = met.join(near.withColumnRenamed("c", "k"), (F.col("c") == F.col("k")) & (F.col("domain") == F.col("above")), "left")
    fits = F.when(F.col("domain") == F.col("c"), 1).when(F.col("domain").isNull(), 2).when(F.col("above").isNotNull(), 3)
    ranked = met.withColumn("rank", F.when(F.col("by_source"), fits).when(fits.isNotNull(), 4)).where("rank is not null")
    return ranked.groupBy("c", "column").agg(F.min(F.struct("rank", "p")).alias("best")).select("c", "column", "best.p", "best.rank")


def loss_manifest(df: DataFrame, numbers: list[str] | None = None, dates: list[str] | None = None, fks: dict[str, tuple[DataFrame, str]] | None = None, others: list[str] | None = None) -> DataFrame:
    """column, n_rows, n_empty, n_sentinel, n_failed, n_unverified: for each column how many cells are empty, stand for a missing value, can't be
    read as their type, or are foreign keys (column: (parent, key)) without a parent. One pass over the table, which meets each parent's distinct keys.
    """
    numbers, dates, fks = numbers or [], dates or [], fks or {}
    columns = [*numbers, *dates, *fks, *(others or [])]
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    for k, (c, (parent, key)) in enumerate(fks.items()):
        known = parent.select(F.col(key).cast("string").alias(c), F.lit(True).alias(f"hit_{k}")).distinct()
        rows = rows.join(known, c, "left")
    hits = {c: F.col(f"hit_{k}").isNull() for k, c in enumerate(fks)}
    aggs = []
    for k, c in enumerate(columns):
        empty, clean = F.coalesce(F.trim(c) == "", F.lit(True)), without_sentinel(F.col(c))
        read = to_number(clean) if c in numbers else to_timestamp(clean) if c in dates else clean
        counts = (F.count_if(empty), F.count_if(~empty & clean.isNull()), F.count_if(clean.isNotNull() & read.isNull()), F.count_if(clean.isNotNull() & hits.get(c, F.lit(False))))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), *[x.alias(n) for x, n in zip(counts, ("n_empty", "n_sentinel", "n_failed", "n_unverified"), strict=True)]).alias(f"m{k}"))
    return rows.agg(*aggs).select(F.explode(F.array(*[f"m{k}" for k in range(len(columns))])).alias("m")).select("m.*")


def loss_budget(manifest: DataFrame, allowed: DataFrame) -> DataFrame:
    """loss, n, rate, passed: the manifest's losses against the share of cells that is allowed (loss, allowed); others are allowed none."""
    kinds = ("n_sentinel", "n_failed", "n_unverified")
    totals = manifest.agg(F.sum("n_rows").alias("cells"), *[F.sum(k).alias(k) for k in kinds])
    each = totals.unpivot(["cells"], list(kinds), "loss", "n").withColumn("rate", F.col("n") / F.greatest("cells", F.lit(1)))
    return each.join(allowed, "loss", "left").select("loss", "n", "rate", (F.col("rate") <= F.coalesce("allowed", F.lit(0.0))).alias("passed"))
