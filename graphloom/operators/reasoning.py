"""Schema-based inference over triples: a semi-naive fixpoint of joins, restrictions, pruning, justification.

Schema tables are small and driver-sized by nature; Spark broadcasts them by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import components, transitive
from graphloom.operators.pairs import joined_pairs
from graphloom.storage import dealt, discard, stored

SPO = ["s", "p", "o", "o_kind"]


def superclasses(subclass: DataFrame) -> DataFrame:
    """(a, b) transitive closure of subclass pairs without loops."""
    return transitive(subclass.where("a <> b")).where("a <> b")


def _of(triples: DataFrame, names: DataFrame) -> DataFrame:
    """The triples of a schema column's properties, as a list of literals, so that a table stored by p is read for them only."""
    return triples.where(F.col("p").isin(sorted({r[0] for r in names.collect()})))  # rows of the schema


def concluded(schema: dict[str, DataFrame]) -> list[str]:
    """The properties of what the rules of derivations can conclude."""
    places = {
        "subproperty": ("b",), "equivalent_property": ("a", "b"), "inverse": ("p", "q"), "symmetric": ("p",), "transitive": ("p",), "chain": ("r",), "has_value": ("p",),
    }
    return sorted({"type"} | {r[0] for k, columns in places.items() if k in schema for c in columns for r in schema[k].select(c).collect()})


def derivations(fresh: DataFrame, known: DataFrame, schema: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """For each rule (rule, triples) that it derives from triples of which one at least is fresh. Rules whose schema table is absent don't fire.

    schema: subclass, equivalent_class, subproperty, equivalent_property (a, b), domain and range (p, c), inverse (p, q), symmetric (p), transitive (p),
    chain (p, q, r: p then q gives r), has_value (c, p, o, o_kind; both ways), some_values and all_values (c, p, d: a value of d gives c; c's values are of d).
    A rule reads the triples of its own properties; the schema's property names are brought to the driver for that.
    """
    iri = fresh.where("o_kind = 'iri'")
    links, types = iri.where("p <> 'type'"), iri.where("p = 'type'")
    made: list[tuple[str, DataFrame]] = []
    typed = lambda df, who: df.select(F.col(who).alias("s"), F.lit("type").alias("p"), F.col("c").alias("o"), F.lit("iri").alias("o_kind"))
    swap = lambda df, p: df.select(F.col("o").alias("s"), F.col(p).alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
    both_ways = lambda df: df.select("a", "b").union(df.select("b", "a")).distinct()

    def above(name: str, pairs: DataFrame) -> None:
        made.append((name, typed(types.join(pairs.select(F.col("a").alias("o"), F.col("b").alias("c")), "o"), "s")))

    def renamed(name: str, pairs: DataFrame) -> None:
        made.append((name, _of(fresh, pairs.select("a")).join(pairs.select(F.col("a").alias("p"), F.col("b").alias("q")), "p").select("s", F.col("q").alias("p"), "o", "o_kind")))

    def chained(name: str, chain: DataFrame) -> None:
        # where all is fresh, the two ways to have a fresh part are one
        for first, second in ((fresh, known), (known, fresh))[: 1 if fresh is known else 2]:
            a = _of(first, chain.select("p")).where("o_kind = 'iri'").join(chain, "p").select("s", F.col("o").alias("m"), "q", "r")
            b = _of(second, chain.select("q")).where("o_kind = 'iri'").select(F.col("s").alias("m"), F.col("p").alias("q"), "o")
            made.append((name, a.join(b, ["m", "q"]).select("s", F.col("r").alias("p"), "o", F.lit("iri").alias("o_kind"))))

    def of_values(name: str, axioms: DataFrame, forward: bool) -> None:
        """some_values (forward): a value of d gives c; else all_values: of what is of c, the values are of d."""
        edge = ("o", "d") if forward else ("s", "c")  # where the type that the rule reads stands, and its class
        for first, second in ((fresh, known), (known, fresh))[: 1 if fresh is known else 2]:
            a = _of(first, axioms.select("p")).where("o_kind = 'iri' and p <> 'type'").join(axioms, "p").select("s", "o", "c", "d")
            b = second.where("o_kind = 'iri' and p = 'type'").select(F.col("s").alias(edge[0]), F.col("o").alias(edge[1]))
            given = a.join(b, list(edge))
            made.append((name, typed(given, "s") if forward else typed(given.select("o", F.col("d").alias("c")), "o")))

    if "domain" in schema:
        made.append(("domain", typed(_of(fresh, schema["domain"].select("p")).join(schema["domain"], "p"), "s")))
    if "range" in schema:
        made.append(("range", typed(_of(links, schema["range"].select("p")).join(schema["range"], "p"), "o")))
    if "subclass" in schema:
        above("subclass", schema["subclass"])
    if "equivalent_class" in schema:
        above("equivalent_class", both_ways(schema["equivalent_class"]))
    if "subproperty" in schema:
        renamed("subproperty", schema["subproperty"])
    if "equivalent_property" in schema:
        renamed("equivalent_property", both_ways(schema["equivalent_property"]))
    if "inverse" in schema:
        pairs = schema["inverse"].select("p", "q")
        both = pairs.select(F.explode(F.array("p", "q")))
        pairs = pairs.unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
        made.append(("inverse", swap(_of(links, both).join(pairs, "p"), "q")))
    if "symmetric" in schema:
        made.append(("symmetric", swap(_of(links, schema["symmetric"].select("p")).join(schema["symmetric"], "p"), "p")))
    if "transitive" in schema:
        chained("transitive", schema["transitive"].select("p", F.col("p").alias("q"), F.col("p").alias("r")))
    if "chain" in schema:
        chained("chain", schema["chain"])
    if "has_value" in schema:
        told = schema["has_value"].select("c", "p", "o", "o_kind")
        made.append(("has_value", typed(_of(fresh, told.select("p")).join(told, ["p", "o", "o_kind"]), "s")))
        made.append(("has_value", types.select("s", F.col("o").alias("c")).join(told, "c").select("s", "p", "o", "o_kind")))
    if "some_values" in schema:
        of_values("some_values", schema["some_values"], True)
    if "all_values" in schema:
        of_values("all_values", schema["all_values"], False)
    return made


def one_step(fresh: DataFrame, known: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """What all rules derive, each triple once; see derivations."""
    return reduce(DataFrame.unionByName, [df for _, df in derivations(fresh, known, schema)]).distinct()


def added(found: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """The triples of found that known lacks, each once, sorted by property in each task; rows is about how many both hold.

    Both are dealt once and grouped: no side is sorted for a join, and a task holds a bounded number, however many there are.
    """
    both = known.select(*SPO, F.lit(False).alias("_new")).unionByName(found.select(*SPO, F.lit(True).alias("_new")))
    return dealt(both, SPO, rows).groupBy(*SPO).agg(F.min("_new").alias("_new")).where("_new").select(*SPO).sortWithinPartitions("p")


def fixpoint(triples: DataFrame, schema: dict[str, DataFrame], kept: bool = False) -> DataFrame:
    """Triples and all that the rules derive. Each round joins only what the last one added and writes only what is new; it ends when nothing is.

    What is known is the union of the rounds' tables, sorted by p, so that rules read their own properties' files and new triples are compared
    with those of properties that rules conclude only. The first round joins all with all in one way, not in two. kept: the triples are read from a table and hold none twice, so they are not stored first.
    """
    first = triples.select(*SPO) if kept else stored(triples.select(*SPO).distinct(), "known", "p")
    made = concluded(schema)
    rounds, sizes = [first], [first.count()]
    while sizes[-1]:
        known = reduce(DataFrame.unionByName, rounds)
        fresh = known if len(rounds) == 1 else rounds[-1]
        found = reduce(DataFrame.unionByName, [df for _, df in derivations(fresh, known, schema)])
        rounds.append(stored(added(found, known.where(F.col("p").isin(made)), sum(sizes) + sizes[-1]), "fresh"))
        sizes.append(rounds[-1].count())
    discard(rounds.pop() if len(rounds) > 1 else None)
    return reduce(DataFrame.unionByName, rounds)


def closure(triples: DataFrame, schema: dict[str, DataFrame], functional: list[str] | None = None, inverse_functional: list[str] | None = None, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """The fixpoint with equality: terms that functional properties, inverse functional ones, class keys or sameAs triples equate become one, the least of them, until nothing moves."""
    known = fixpoint(triples, schema)
    while True:
        pairs = [known.where("p = 'sameAs' and s <> o").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"))]
        pairs += [same_as(known, functional)] if functional else []
        turned = known.where("o_kind = 'iri'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind")
        pairs += [same_as(turned, inverse_functional)] if inverse_functional else []
        pairs += [has_key(known, c, own) for c, own in (keys or {}).items()]
        same = stored(reduce(DataFrame.unionByName, pairs).distinct(), "same")
        if same.isEmpty():
            return known
        known = fixpoint(merged_terms(known, same).where("not (p = 'sameAs' and s = o)"), schema)


def restriction_violations(triples: DataFrame, restrictions: DataFrame, subclass: DataFrame) -> DataFrame:
    """s, c, p, target, kind of members that break restrictions (c, p, target, kind), those of subclasses included; each instance, property and target once.

    kind has_value: no such value; some_values: no value of class target, subclasses counted.
    """
    up = superclasses(subclass)
    ty = triples.where("p = 'type'").select("s", F.col("o").alias("c")).distinct()
    closed = ty.join(up.select(F.col("a").alias("c"), F.col("b").alias("above")), "c").select("s", F.col("above").alias("c")).unionByName(ty).distinct()
    due = closed.join(restrictions, "c").groupBy("s", "p", "target", "kind").agg(F.min("c").alias("c"))
    own = triples.join(restrictions.select("p").distinct(), "p", "left_semi").where("p <> 'type'")
    plain = own.select("s", "p", F.col("o").alias("target"), F.lit("has_value").alias("kind"))
    of_class = own.where("o_kind = 'iri'").join(closed.select(F.col("s").alias("o"), F.col("c").alias("target")), "o").select("s", "p", "target", F.lit("some_values").alias("kind"))
    return due.join(plain.unionByName(of_class).distinct(), ["s", "p", "target", "kind"], "left_anti").select("s", "c", "p", "target", "kind")


def same_as(triples: DataFrame, functional: list[str]) -> DataFrame:
    """(a, b), a < b: objects that a functional property gives one subject."""
    of = triples.where(F.col("p").isin(functional) & (F.col("o_kind") == "iri"))
    least = of.groupBy("s", "p").agg(F.min("o").alias("a"))
    return of.join(least, ["s", "p"]).where("a < o").select("a", F.col("o").alias("b")).distinct()


def has_key(triples: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """(a, b), a < b: instances of the class that share a value of every key property; a is the least of those with one combination.

    Instances are grouped by combination, so a common value makes one row an instance, not all pairs.
    """
    own = triples.where((F.col("p") == "type") & (F.col("o") == c)).select("s").distinct()
    for k, p in enumerate(keys):
        own = own.join(triples.where(F.col("p") == p).select("s", F.col("o").alias(f"key_{k}")).distinct(), "s")
    names = [f"key_{k}" for k in range(len(keys))]
    least = own.groupBy(*names).agg(F.min("s").alias("a"))
    return own.join(least, names).where("a < s").select("a", F.col("s").alias("b")).distinct()


def merged_terms(triples: DataFrame, same: DataFrame) -> DataFrame:
    """The triples with every subject and object IRI replaced by the least term that pairs (a, b) of same terms lead to."""
    if same.isEmpty():
        return triples
    to = stored(components(same.select("a", "b")), "same")
    named = lambda c: to.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
    out = triples.join(named("s"), "s", "left").join(named("o"), "o", "left")
    out = out.withColumns({"s": F.coalesce("s_to", "s"), "o": F.when(F.col("o_kind") == "iri", F.coalesce("o_to", "o")).otherwise(F.col("o"))})
    return out.select(*triples.columns).dropDuplicates(["s", "p", "o"])


def intersection_of(triples: DataFrame, c: str, members: list[str]) -> DataFrame:
    """(s, c) that an intersection adds: what is of all members is of c, what is of c is of each member."""
    ty = triples.where(F.col("p") == "type").select("s", F.col("o").alias("c")).distinct()
    of_all = ty.where(F.col("c").isin(members)).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") == len(set(members))).select("s", F.lit(c).alias("c"))
    of_each = ty.where(F.col("c") == c).select("s", F.explode(F.array(*[F.lit(m) for m in members])).alias("c"))
    return of_all.unionByName(of_each).distinct().join(ty, ["s", "c"], "left_anti")


def union_of(triples: DataFrame, c: str, members: list[str]) -> DataFrame:
    """(s, c) that a union adds: what is of a member is of c."""
    ty = triples.where(F.col("p") == "type").select("s", F.col("o").alias("c")).distinct()
    return ty.where(F.col("c").isin(members)).select("s", F.lit(c).alias("c")).distinct().join(ty, ["s", "c"], "left_anti")


def delta(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.join(before.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def inverse_complete(triples: DataFrame, inverse: DataFrame) -> DataFrame:
    """Triples with the missing inverse edges of both directions."""
    return triples.select(*SPO).unionByName(one_step(triples, triples, {"inverse": inverse})).distinct()


def has_value(triples: DataFrame, p: str, value: str, c: str) -> DataFrame:
    """(s, c) of subjects with that value."""
    return triples.where((F.col("p") == p) & (F.col("o") == value)).select("s", F.lit(c).alias("c")).distinct()


def some_values(triples: DataFrame, p: str, member_of: str, c: str) -> DataFrame:
    """(s, c) of subjects with a value of the class."""
    members = triples.where((F.col("p") == "type") & (F.col("o") == member_of)).select(F.col("s").alias("o"))
    return triples.where(F.col("p") == p).join(members, "o", "left_semi").select("s", F.lit(c).alias("c")).distinct()


def all_values(triples: DataFrame, p: str, member_of: str, c: str) -> DataFrame:
    """(s, c) of subjects with a value, all of whose IRI values are of the class; literals are ignored."""
    members = triples.where((F.col("p") == "type") & (F.col("o") == member_of)).select(F.col("s").alias("o"))
    own = triples.where((F.col("p") == p) & (F.col("o_kind") == "iri"))
    return own.select("s").distinct().join(own.join(members, "o", "left_anti").select("s"), "s", "left_anti").select("s", F.lit(c).alias("c"))


def min_cardinality(triples: DataFrame, p: str, n: int, c: str) -> DataFrame:
    return triples.where(F.col("p") == p).groupBy("s").agg(F.count_distinct("o").alias("n")).where(F.col("n") >= n).select("s", F.lit(c).alias("c"))


def prune_noise(triples: DataFrame, data_properties: list[str], object_properties: list[str], datatypes: dict[str, str] | None = None) -> DataFrame:
    """Triples with the reason to drop them, or keep: an equality or subclass pair of a term with itself, a trivial superclass, a literal subject, a literal on an object
    property, an IRI on a data property, and, given the data properties' types, a literal whose o_dt is another (null is another too). Properties of both lists keep their triples.

    s_kind, where the triples have it, tells literal subjects.
    """
    both = set(data_properties) & set(object_properties)
    loop = F.col("s") == F.col("o")
    reason = F.when((F.col("p") == "sameAs") & loop, "self_same").when((F.col("p") == "equivalentClass") & loop, "self_equivalent")
    if "s_kind" in triples.columns:
        reason = reason.when(F.col("s_kind") == "lit", "literal_subject")
    reason = reason.when((F.col("p") == "subClassOf") & F.col("o").isin("Thing", "Resource"), "trivial_superclass")
    reason = reason.when((F.col("p") == "subClassOf") & loop, "self_subclass")
    for p, dt in (datatypes or {}).items():
        reason = reason.when((F.col("p") == p) & (F.col("o_kind") == "lit") & ~F.col("o_dt").eqNullSafe(F.lit(dt)), "other_datatype")
    reason = reason.when(F.col("p").isin(sorted(set(object_properties) - both)) & (F.col("o_kind") == "lit"), "literal_on_object_property")
    reason = reason.when(F.col("p").isin(sorted(set(data_properties) - both)) & (F.col("o_kind") == "iri"), "iri_on_data_property")
    return triples.withColumn("reason", F.coalesce(reason, F.lit("keep")))


def type_pollution(before: DataFrame, added: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(s, new, old) added types that are disjoint (a, b, either way) with a type held before."""
    both = disjoint.select("a", "b").union(disjoint.select("b", "a"))
    held = before.where("p = 'type'").select("s", F.col("o").alias("b"))
    new = added.where("p = 'type'").select("s", F.col("o").alias("a"))
    return new.join(both, "a").join(held, ["s", "b"], "left_semi").join(held, ["s", "b"]).select("s", F.col("a").alias("new"), F.col("b").alias("old")).distinct()


def without_pollution(before: DataFrame, added: DataFrame, disjoint: DataFrame) -> DataFrame:
    """added without the types that are disjoint with a type held before."""
    bad = type_pollution(before, added, disjoint).select("s", F.lit("type").alias("p"), F.col("new").alias("o")).distinct()
    return added.join(bad, ["s", "p", "o"], "left_anti")


RULE_ORDER = ("already_exists", "domain", "range", "subclass", "inverse", "symmetric", "transitive")


def justify(derived: DataFrame, before: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """(s, p, o, rule): the first rule, in fixed order, that derives a triple from the ones before; unknown if none does in one step.

    Every rule tags what it derives, once; the tagged triples meet the derived ones in one join, which keeps the least rank.
    """
    key = ["s", "p", "o"]
    made = derivations(before, before, {name: schema[name] for name in RULE_ORDER if name in schema})
    tagged = [before.select(*key, F.lit(0).alias("rank")), *[df.select(*key, F.lit(RULE_ORDER.index(name)).alias("rank")) for name, df in made]]
    best = reduce(DataFrame.unionByName, tagged).groupBy(*key).agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(r) for r in RULE_ORDER])
    return derived.select(*key).join(best, key, "left").select(*key, F.coalesce(F.get(names, F.col("rank")), F.lit("unknown")).alias("rule"))


def justified(derived: DataFrame, before: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """s, p, o, rule, premises, confidence of derived triples: the first rule, in fixed order, that yields one from the triples before, and what it yields it from.

    premises are texts of the stated triples and the axiom, the least of a rule's possible ones; confidence is high, or low for unknown. Each rule starts from
    the derived triples and looks for its premises, so a single triple (to explain one) costs lookups of its own terms, not a pass over all conclusions.
    """
    key = ["s", "p", "o"]
    own, held = derived.select(*key).distinct(), before.select(*key)
    known = lambda s, p, o: held.select(F.col("s").alias(s), F.col("p").alias(p), F.col("o").alias(o))
    told = lambda *terms: F.concat(F.lit("("), F.concat_ws(", ", *terms), F.lit(")"))
    stated, axiom = (lambda *x: F.concat(told(*x), F.lit(" stated"))), (lambda *x: F.concat(told(*x), F.lit(" in the schema")))
    types, links = own.where("p = 'type'"), own.where("p <> 'type'")
    any_ = F.lit("_")
    found: list[tuple[str, DataFrame, list[Column]]] = [("already_exists", own.join(held, key, "left_semi"), [])]
    if "domain" in schema:
        on = types.join(schema["domain"].select(F.col("p").alias("q"), F.col("c").alias("o")), "o").join(known("s", "q", "_v"), ["s", "q"], "left_semi")
        found.append(("domain", on, [stated("s", "q", any_), axiom("q", F.lit("domain"), "o")]))
    if "range" in schema:
        reached = before.where("o_kind = 'iri'").select(F.col("o").alias("s"), F.col("p").alias("q"))
        on = types.join(schema["range"].select(F.col("p").alias("q"), F.col("c").alias("o")), "o").join(reached, ["s", "q"], "left_semi")
        found.append(("range", on, [stated(any_, "q", "s"), axiom("q", F.lit("range"), "o")]))
    if "subclass" in schema:
        on = types.join(schema["subclass"].select(F.col("a").alias("q"), F.col("b").alias("o")), "o").join(known("s", "_p", "q").where("_p = 'type'"), ["s", "q"], "left_semi")
        found.append(("subclass", on, [stated("s", F.lit("type"), "q"), axiom("q", F.lit("subClassOf"), "o")]))
    if "inverse" in schema:
        both = schema["inverse"].select("p", "q").union(schema["inverse"].select("q", "p")).distinct()
        on = links.join(both, "p").join(known("o", "q", "s"), ["s", "q", "o"], "left_semi")
        found.append(("inverse", on, [stated("o", "q", "s"), axiom("p", F.lit("inverseOf"), "q")]))
    if "symmetric" in schema:
        on = links.join(schema["symmetric"].select("p"), "p").join(known("o", "p", "s"), key, "left_semi")
        found.append(("symmetric", on, [stated("o", "p", "s"), axiom("p", F.lit("type"), F.lit("SymmetricProperty"))]))
    if "transitive" in schema:
        on = links.join(schema["transitive"].select("p"), "p").join(known("s", "p", "q"), ["s", "p"]).join(known("q", "p", "o"), ["q", "p", "o"], "left_semi")
        found.append(("transitive", on, [stated("s", "p", "q"), stated("q", "p", "o"), axiom("p", F.lit("type"), F.lit("TransitiveProperty"))]))
    none = F.array().cast("array<string>")
    rows = [df.select(*key, F.lit(RULE_ORDER.index(rule)).alias("rank"), (F.array(*why) if why else none).alias("premises")) for rule, df, why in found]
    best = reduce(DataFrame.unionByName, rows).groupBy(*key).agg(F.min(F.struct("rank", "premises")).alias("x"))
    names = F.array(*[F.lit(r) for r in RULE_ORDER])
    out = own.join(best, key, "left").select(*key, F.coalesce(F.get(names, F.col("x.rank")), F.lit("unknown")).alias("rule"), F.coalesce("x.premises", none).alias("premises"))
    return out.withColumn("confidence", F.when(F.col("rule") == "unknown", "low").otherwise("high"))


def classified(added: DataFrame, trivial_classes: list[str], known_classes: list[str]) -> DataFrame:
    """added with kind: trivial (self link, universal class), suspicious (type of no known class), meaningful."""
    is_type = F.col("p") == "type"
    kind = F.when((F.col("s") == F.col("o")) | (is_type & F.col("o").isin(trivial_classes)), "trivial").when(is_type & ~F.col("o").isin(known_classes), "suspicious").otherwise("meaningful")
    return added.withColumn("kind", kind)


def explosion_risk(triples: DataFrame, transitive_: list[str], symmetric: list[str]) -> DataFrame:
    """One row: shares of transitive and symmetric properties in percent, and the risk."""
    share = lambda names: F.count_if(F.col("p").isin(names)) * 100.0 / F.greatest(F.count("*"), F.lit(1))
    row = triples.agg(share(transitive_).alias("transitive_pct"), share(symmetric).alias("symmetric_pct"))
    return row.withColumn("risk", F.when(F.col("transitive_pct") > 10, "HIGH").when((F.col("transitive_pct") > 2) | (F.col("symmetric_pct") > 5), "MEDIUM").otherwise("LOW"))


def rule_body(*parts: DataFrame, where=None, head: tuple[str, str, str] = ("?s", "p", "?o"), on_head: bool = False) -> DataFrame:
    """A conjunctive rule: patterns joined, built-ins (greater than, different from) as where, one head triple.

    on_head tells that where names variables of the head only. Then, if the last part has the head's object and shares one variable with the others, which
    have its subject, bindings are met as pairs of a path: spread over tasks, and not compared with each other where none can repeat.
    """
    from graphloom.operators.graph import construct, join

    s, o = head[0][1:], head[2][1:]
    if on_head and len(parts) > 1 and head[0].startswith("?") and head[2].startswith("?") and not head[1].startswith("?"):
        rest, last = join(*parts[:-1]), parts[-1]
        shared = [c for c in rest.columns if c in last.columns]
        if len(shared) == 1 and s in rest.columns and s not in last.columns and o in last.columns and o not in rest.columns:
            sides = rest.select(F.col(s).alias("a"), F.col(shared[0]).alias("b")).dropna(), last.select(F.col(shared[0]).alias("b"), F.col(o).alias("c")).dropna()
            body = joined_pairs(*sides).select(F.col("a").alias(s), F.col("c").alias(o))
            return (body if where is None else body.where(where)).select(F.col(s).alias("s"), F.lit(head[1]).alias("p"), F.col(o).alias("o"))
    body = join(*parts)
    return construct(body if where is None else body.where(where), head)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
