"""The graph that the catalogue's queries run on: relational tables as triples by a stated mapping.

Class, key, foreign keys and properties of each table are in MAPPING; both the Spark plan and the oracle's SQL come
from it. Numbers are written as decimals with two places. Some orders are given defects on purpose, so that
checks have something to find: every 97th order points to a missing customer, every 89th has no status, every 83rd has two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import graph_store
from graphloom.sources.tables import inline, table

#: table: (class, key, {foreign key: (property, class)}, {text column: property}, {number column: property})
MAPPING = {
    "region": ("Region", "r_regionkey", {}, {"r_name": "regionName"}, {}),
    "nation": ("Nation", "n_nationkey", {"n_regionkey": ("inRegion", "Region")}, {"n_name": "nationName"}, {}),
    "customer": ("Customer", "c_custkey", {"c_nationkey": ("inNation", "Nation")}, {"c_mktsegment": "segment"}, {"c_acctbal": "balance"}),
    "supplier": ("Supplier", "s_suppkey", {"s_nationkey": ("basedIn", "Nation")}, {}, {"s_acctbal": "supplierBalance"}),
    "part": ("Part", "p_partkey", {}, {"p_brand": "brand", "p_type": "partType"}, {"p_size": "size", "p_retailprice": "price"}),
    "orders": ("Order", "o_orderkey", {"o_custkey": ("placedBy", "Customer")}, {"o_orderstatus": "status", "o_orderpriority": "priority"}, {"o_totalprice": "total"}),
}

#: (property, domain, range) of the object properties.
OBJECT_PROPERTIES = [(p, own, target) for own, _, fks, _, _ in MAPPING.values() for p, target in fks.values()]
DATA_PROPERTIES = [(p, own) for own, _, _, texts, numbers in MAPPING.values() for p in (*texts.values(), *numbers.values())]
INVERSES = [("inNation", "nationOfCustomer"), ("placedBy", "placed")]
SUBCLASSES = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Nation", "Place"), ("Region", "Place"), ("Order", "Event")]


def _defect(fk: str) -> tuple[str, str]:
    """Key expressions (Spark, DuckDB) of a foreign key with its defect."""
    if fk == "o_custkey":
        return ("CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_custkey END",) * 2
    return (fk, fk)


def table_triples(rows: DataFrame, name: str) -> list[DataFrame]:
    """The triples of one table of MAPPING, a branch for each predicate (two for the defects of status)."""
    own, key, fks, texts, numbers = MAPPING[name]
    none = F.lit(None).cast("double")
    s = F.concat(F.lit(f"{own}_"), F.col(key).cast("string"))

    def branch(p: str, o: Column, kind: str, num: Column = none) -> DataFrame:
        return rows.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), num.alias("o_num")).where("o is not null")

    parts = [branch("type", F.lit(own), "iri")]
    parts += [branch(p, F.concat(F.lit(f"{target}_"), F.expr(_defect(fk)[0]).cast("string")), "iri") for fk, (p, target) in fks.items()]
    for c, p in texts.items():
        if p == "status":
            parts.append(branch(p, F.when(F.col("o_orderkey") % 89 != 0, F.col(c)), "lit"))
            parts.append(branch(p, F.when(F.col("o_orderkey") % 83 == 0, F.lit("X")), "lit"))
        else:
            parts.append(branch(p, F.col(c), "lit"))
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    return parts + [branch(p, exact(c).cast("string"), "lit", exact(c).cast("double")) for c, p in numbers.items()]


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples s, p, o, o_kind (iri or lit), o_num (double).

    Each predicate is a branch that scans its own columns, so a filter on p leaves the others' tables unread. The keys of MAPPING are unique in
    their tables, so no triple is made twice and none has to be compared with others.
    """
    return reduce(DataFrame.unionByName, [x for name in MAPPING for x in table_triples(table(spark, sf_dir, name), name)])


def kept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same triples from the shared store: tables whose files have not changed since they were converted are not read again."""

    def convert(name: str) -> graph_store.Conversion:
        return lambda spark, path: reduce(DataFrame.unionByName, table_triples(spark.read.parquet(path), name))

    of = lambda name: (convert(name), f"{name}: {MAPPING[name]}, {_defect('o_custkey')[0]}, version 1")
    return graph_store.load(spark, {f"{sf_dir}/{name}.parquet": of(name) for name in MAPPING})[0]


def graph_sql() -> str:
    """The same triples in DuckDB's SQL, as a query."""
    parts = []
    for name, (own, key, fks, texts, numbers) in MAPPING.items():
        s = f"'{own}_' || {key}"
        parts.append(f"SELECT {s} AS s, 'type' AS p, '{own}' AS o, 'iri' AS o_kind, NULL::DOUBLE AS o_num FROM {name}")
        parts += [f"SELECT {s}, '{p}', '{target}_' || ({_defect(fk)[1]}), 'iri', NULL FROM {name}" for fk, (p, target) in fks.items()]
        for c, p in texts.items():
            parts.append(f"SELECT {s}, '{p}', {c}, 'lit', NULL FROM {name} WHERE {c} IS NOT NULL" + (" AND o_orderkey % 89 <> 0" if p == "status" else ""))
            if p == "status":
                parts.append(f"SELECT {s}, '{p}', 'X', 'lit', NULL FROM {name} WHERE o_orderkey % 83 = 0")
        parts += [f"SELECT {s}, '{p}', {c}::DECIMAL(18,2)::VARCHAR, 'lit', {c}::DECIMAL(18,2)::DOUBLE FROM {name} WHERE {c} IS NOT NULL" for c, p in numbers.items()]
    return " UNION ".join(parts)


def schema_rows(spark: SparkSession) -> dict[str, DataFrame]:
    """The schema as small tables: subclass, domain, range, inverse."""
    of = lambda rows, names: inline(spark, rows, ", ".join(f"{n} string" for n in names))
    return {
        "subclass": of(SUBCLASSES, ("a", "b")),
        "domain": of([(p, d) for p, d, _ in OBJECT_PROPERTIES] + DATA_PROPERTIES, ("p", "c")),
        "range": of([(p, r) for p, _, r in OBJECT_PROPERTIES], ("p", "c")),
        "inverse": of(INVERSES, ("p", "q")),
    }
