"""Queries of the mutation audit; their oracle applies each mutant to the whole graph and runs each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalogue import _values
from graphloom.catalogue_rules import on_kept_graph
from graphloom.operators import mutation as mu
from graphloom.plans import star_graph as sg
from graphloom.sources.tables import inline

NUMBERS = [(p,) for *_, own in sg.MAPPING.values() for p in own.values()]
SCHEMA = {
    "domain": ("p string, c string", [(p, c) for p, c, _ in sg.OBJECT_PROPERTIES] + sg.DATA_PROPERTIES),
    "range": ("p string, c string", [(p, c) for p, _, c in sg.OBJECT_PROPERTIES]),
    "object_property": ("p string", [(p,) for p, _, _ in sg.OBJECT_PROPERTIES]),
    "data_property": ("p string", [(p,) for p, _ in sg.DATA_PROPERTIES]),
    "functional": ("p string", [("status",), ("segment",), ("inNation",)]),
    "number": ("p string", NUMBERS),
    "required": ("c string, p string", [("Customer", "segment"), ("Customer", "inNation"), ("Supplier", "basedIn"), ("Order", "status")]),
    "disjoint": ("a string, b string", [("Customer", "Supplier"), ("Order", "Customer")]),
    "referenced": ("c string", [("Nation",), ("Region",), ("Customer",)]),
}
#: mutant: (triples that it takes away, what it adds for each of them: s, p, o, o_kind), as conditions and expressions that both engines read.
MUTANTS = {
    "drop type": ("p = 'type' AND s LIKE 'Supplier%7'", None),
    "drop link": ("p = 'inNation' AND s LIKE '%3'", None),
    "point nowhere": ("p = 'placedBy' AND s LIKE '%11'", ("s", "p", "'Ghost_1'", "'iri'")),
    "point to another class": ("p = 'inNation' AND s LIKE '%5'", ("s", "p", "'Region_1'", "'iri'")),
    "drop value": ("p = 'segment' AND s LIKE '%2'", None),
    "link as text": ("p = 'basedIn' AND s LIKE '%4'", ("s", "p", "o", "'lit'")),
    "text as link": ("p = 'segment' AND s LIKE '%6'", ("s", "p", "o", "'iri'")),
    "rename property": ("p = 'balance' AND s LIKE '%1'", ("s", "'balanse'", "o", "o_kind")),
    "no number": ("p = 'supplierBalance' AND s LIKE '%0'", ("s", "p", "'n/a'", "'lit'")),
    "other case": ("p = 'nationName' AND s LIKE '%2'", ("s", "p", "lower(o)", "o_kind")),
    "drop node": ("s LIKE 'Customer%19'", None),
    "wrong owner": ("p = 'status' AND s LIKE '%77'", ("'Nation_1'", "p", "o", "o_kind")),
}
#: mutants that only add: for each triple that fits, one more.
ADDED = {
    "second value": ("p = 'type' AND s LIKE 'Order%9'", ("s", "'status'", "'Z'", "'lit'")),
    "second type": ("p = 'type' AND s LIKE 'Customer%8'", ("s", "'type'", "'Supplier'", "'iri'")),
    "link to itself": ("p = 'type' AND s LIKE 'Nation%3'", ("s", "'inRegion'", "s", "'iri'")),
}


def _deltas(t: DataFrame) -> DataFrame:
    rows = []
    for name, (where, to) in (MUTANTS | ADDED).items():
        own = t.where(where)
        if name in MUTANTS:
            rows.append(own.select(F.lit(name).alias("m"), F.lit(-1).alias("sign"), *mu.TRIPLE))
        if to is not None:
            rows.append(own.select(F.lit(name).alias("m"), F.lit(1).alias("sign"), *[F.expr(x).alias(c) for x, c in zip(to, mu.TRIPLE, strict=True)]))
    return reduce(DataFrame.unionByName, rows)


def _v(name: str) -> str:
    columns, rows = SCHEMA[name]
    return f"(VALUES {_values(rows)}) AS x({', '.join(c.split()[0] for c in columns.split(', '))})"


def _checks(g: str) -> dict[str, str]:
    """SQL of the nodes that fail each check in a table of triples."""
    ty = f"(SELECT DISTINCT s AS node, o AS c FROM {g} WHERE p = 'type')"
    link, plain = f"(SELECT * FROM {g} WHERE o_kind = 'iri' AND p <> 'type')", f"(SELECT * FROM {g} WHERE p <> 'type')"
    return {
        "untyped": f"SELECT s FROM {plain} WHERE s NOT IN (SELECT node FROM {ty})",
        "dangling": f"SELECT s FROM {link} WHERE o NOT IN (SELECT node FROM {ty})",
        "domain": f"SELECT s FROM {plain} JOIN {_v('domain')} USING (p) WHERE (s, c) NOT IN (SELECT node, c FROM {ty})",
        "range": f"SELECT s FROM {link} JOIN {_v('range')} USING (p) WHERE o IN (SELECT node FROM {ty}) AND (o, c) NOT IN (SELECT node, c FROM {ty})",
        "functional": f"SELECT s FROM {plain} WHERE p IN (SELECT p FROM {_v('functional')}) GROUP BY s, p HAVING count(DISTINCT (o, o_kind)) > 1",
        "missing": f"SELECT node FROM {ty} JOIN {_v('required')} USING (c) WHERE (node, p) NOT IN (SELECT s, p FROM {plain})",
        "literal_on_object": f"SELECT s FROM {plain} WHERE o_kind = 'lit' AND p IN (SELECT p FROM {_v('object_property')})",
        "iri_on_data": f"SELECT s FROM {link} WHERE p IN (SELECT p FROM {_v('data_property')})",
        "disjoint": f"SELECT y.node FROM {ty} y JOIN {_v('disjoint')} ON y.c = x.a JOIN {ty} z ON z.node = y.node AND z.c = x.b",
        "undeclared": f"SELECT s FROM {plain} WHERE p NOT IN (SELECT p FROM {_v('object_property')} UNION SELECT p FROM {_v('data_property')})",
        "self_link": f"SELECT s FROM {link} WHERE s = o",
        "unreferenced": f"SELECT node FROM {ty} WHERE c IN (SELECT c FROM {_v('referenced')}) AND node NOT IN (SELECT o FROM {link})",
        "bad_number": f"SELECT s FROM {plain} WHERE o_kind = 'lit' AND p IN (SELECT p FROM {_v('number')}) AND try_cast(o AS DOUBLE) IS NULL",
    }


def _matrix_sql() -> str:
    """Each mutant's graph, and in it the nodes that fail each check."""
    graphs, rows = [], []
    for k, (name, (where, to)) in enumerate((MUTANTS | ADDED).items()):
        kept = f"SELECT s, p, o, o_kind FROM g WHERE NOT ({where})" if name in MUTANTS else "SELECT s, p, o, o_kind FROM g"
        graphs.append(f"g{k} AS MATERIALIZED ({kept}" + (f" UNION SELECT {', '.join(to)} FROM g WHERE {where})" if to else ")"))
        for check, sql in _checks(f"g{k}").items():
            rows.append(f"SELECT '{name}' AS mutant, '{check}' AS \"check\", (SELECT count(DISTINCT node) FROM ({sql}) AS z(node)) AS after")
    base = " UNION ALL ".join(f"SELECT '{check}' AS \"check\", (SELECT count(DISTINCT node) FROM ({sql}) AS z(node)) AS before" for check, sql in _checks("g").items())
    return f", {', '.join(graphs)}, b AS ({base}), a AS ({' UNION ALL '.join(rows)}), mx AS (SELECT mutant, \"check\", before, after, after > before AS noticed FROM a JOIN b USING (\"check\"))"


MATRIX = _matrix_sql()


def _matrix(t: DataFrame) -> DataFrame:
    return mu.sensitivity(t, _deltas(t), {k: inline(t.sparkSession, rows, columns) for k, (columns, rows) in SCHEMA.items()})


@on_kept_graph(f"{MATRIX} SELECT * FROM mx")
def mutation_matrix(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return _matrix(t)


@on_kept_graph(f"""{MATRIX} SELECT 'blind_spot' AS kind, mutant AS name FROM mx GROUP BY mutant HAVING NOT bool_or(noticed) UNION ALL SELECT 'dead_check', "check" FROM mx GROUP BY "check" HAVING NOT bool_or(noticed)""")
def mutation_audit(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return mu.audit(_matrix(t))
