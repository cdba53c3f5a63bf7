"""Lint of a schema given as small tables: (rule, subject) rows, none for a clean schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import transitive
from graphloom.storage import stored


def lint(classes: DataFrame, properties: DataFrame, subclass: DataFrame, subproperty: DataFrame, inverse: DataFrame, transitive_: DataFrame, disjoint: DataFrame) -> DataFrame:
    """rule and subject of every violation.

    classes (c, label, deprecated), properties (p, domain, range, label; a row for each domain and range), subclass, subproperty and
    disjoint (a, b), inverse (p, q), transitive_ (p). Rules: missing label, duplicate label, class and property naming, missing and multiple
    domain or range, isolated class, self and cyclic subclass, cyclic subproperty, self inverse, transitive self loop, deprecated reference, siblings without disjointness.
    """
    found = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    props = properties.groupBy("p").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("range").alias("ranges"), F.max("label").alias("label"))
    named = classes.select(F.col("c").alias("term"), "label").unionByName(props.select(F.col("p").alias("term"), "label"))
    linked = subclass.select("a").union(subclass.select("b")).union(properties.select("domain")).union(properties.select("range")).toDF("c")
    loops = lambda df: transitive(df.where("a <> b")).where("a = b")
    siblings = subclass.alias("x").join(subclass.alias("y"), F.col("x.b") == F.col("y.b")).where("x.a < y.a").select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    apart = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    old = classes.where("deprecated").select("c")
    rows = [
        found("missing_label", named.where("label is null or trim(label) = ''"), "term"),
        found("duplicate_label", named.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "label"),
        found("class_naming", classes.where(~F.col("c").rlike("^[A-Z][A-Za-z0-9]*$")), "c"),
        found("property_naming", props.where(~F.col("p").rlike("^[a-z][A-Za-z0-9]*$")), "p"),
        found("missing_domain_range", props.where("domains = 0 or ranges = 0"), "p"),
        found("multiple_domain_range", props.where("domains > 1 or ranges > 1"), "p"),
        found("isolated_class", classes.join(linked, "c", "left_anti"), "c"),
        found("self_subclass", subclass.where("a = b"), "a"),
        found("subclass_cycle", loops(subclass), "a"),
        found("subproperty_cycle", loops(subproperty), "a"),
        found("self_inverse", inverse.where("p = q"), "p"),
        found("transitive_self_loop", transitive_.join(properties.where("domain <> range"), "p", "left_semi"), "p"),
        found("deprecated_reference", properties.join(old, (F.col("domain") == F.col("c")) | (F.col("range") == F.col("c"))).select("p"), "p"),
        found("siblings_not_disjoint", siblings.join(apart, ["a", "b"], "left_anti"), "a"),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def lint_axioms(classes: DataFrame, properties: DataFrame, inverse: DataFrame, transitive_: DataFrame, restrictions: DataFrame, equivalent: DataFrame, disjoint: DataFrame, groups: DataFrame, wanted: DataFrame, least_wanted: int = 3) -> DataFrame:
    """rule and subject of every violation among axioms.

    classes (c, label, comment), restrictions (c, p), equivalent and disjoint (a, b), groups: disjoint groups that the schema declares (g, c), wanted:
    those that it should (g, c); the others as for lint. Rules: a transitive property with an inverse; pairwise disjointness without any group; a
    restriction on a property whose domain is the class itself; a label without a comment; a cycle of equivalent classes; fewer
    groups than wanted ones of which two classes or more exist, told only of least_wanted such groups or more.
    """
    found = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    own = properties.select("p", F.col("domain").alias("c"))
    known = equivalent.where("a <> b").join(classes.select(F.col("c").alias("a")), "a", "left_semi").join(classes.select(F.col("c").alias("b")), "b", "left_semi")
    due = wanted.join(classes.select("c"), "c", "left_semi").groupBy("g").agg(F.count_distinct("c").alias("n")).where("n >= 2").select(F.lit(1).alias("due"), F.lit(0).alias("there"))
    counted = due.unionByName(groups.select("g").distinct().select(F.lit(0).alias("due"), F.lit(1).alias("there"))).agg(F.sum("due").alias("due"), F.sum("there").alias("there"))
    lacking = counted.where((F.col("due") >= least_wanted) & (F.col("there") < F.col("due")))
    rows = [
        found("circular_property", transitive_.join(inverse.select("p"), "p", "left_semi"), "p"),
        found("disjoint_style", disjoint.withColumn("all", F.lit(1)).join(groups.select(F.lit(1).alias("all")).distinct(), "all", "left_anti"), "a"),
        found("self_referencing_restriction", restrictions.join(own, ["c", "p"], "left_semi"), "c"),
        found("asymmetric_annotation", classes.where("label is not null and comment is null"), "c"),
        found("equivalent_class_cycle", transitive(known).where("a = b"), "a"),
        found("disjoint_presence", lacking.select(F.concat(F.lit("groups missing: "), (F.col("due") - F.col("there")).cast("string")).alias("c")), "c"),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def depths(subclass: DataFrame) -> DataFrame:
    """(c, depth) of classes below a root: the longest chain of subclass pairs (a below b) to it. Pairs on a cycle are left out."""
    pairs = subclass.select("a", "b").where("a <> b").distinct()
    back = transitive(pairs).select(F.col("a").alias("b"), F.col("b").alias("a"))
    edges = stored(pairs.join(back, ["a", "b"], "left_anti"), "tree")
    level = stored(edges.select(F.col("b").alias("c")).join(edges.select(F.col("a").alias("c")), "c", "left_anti").distinct(), "level")
    found, depth = [level.withColumn("depth", F.lit(0))], 0
    while not level.isEmpty():
        depth += 1
        level = stored(edges.join(level.withColumnRenamed("c", "b"), "b", "left_semi").select(F.col("a").alias("c")).distinct(), "level")
        found.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found).groupBy("c").agg(F.max("depth").alias("depth"))


def schema_metrics(classes: DataFrame, subclass: DataFrame, object_properties: DataFrame, data_properties: DataFrame) -> DataFrame:
    """metric, value (six places): depth of inheritance, children a class (mean, most), share of object properties, data properties of a class that has any, share of annotated terms, share of classes with two parents or more.

    classes (c, label, comment), object_properties (p, label, comment), data_properties (p, domain, label, comment; a row for each domain). An
    empty schema has 0 throughout.
    """
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    below = subclass.join(classes.select(F.col("c").alias("a")), "a", "left_semi").join(classes.select(F.col("c").alias("b")), "b", "left_semi").where("a <> b").distinct()
    per_class = classes.select("c").distinct().join(below.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("children")), "c", "left")
    per_class = per_class.join(below.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("parents")), "c", "left")
    per_class = per_class.join(data_properties.groupBy(F.col("domain").alias("c")).agg(F.count_distinct("p").alias("data")), "c", "left").na.fill(0)
    of_classes = per_class.agg(
        F.coalesce(F.avg("children"), F.lit(0.0)).alias("children_mean"), F.coalesce(F.max("children"), F.lit(0)).cast("double").alias("children_most"),
        share(F.sum("data"), F.count_if(F.col("data") > 0)).alias("attribute_richness"), share(F.count_if(F.col("parents") > 1), F.count("*")).alias("multi_parent_share"),
    )
    terms = [classes.select(F.lit("class").alias("kind"), F.col("c").alias("term"), "label", "comment")]
    terms += [df.select(F.lit(kind).alias("kind"), F.col("p").alias("term"), "label", "comment") for kind, df in (("object", object_properties), ("data", data_properties))]
    each = reduce(DataFrame.unionByName, terms).groupBy("kind", "term").agg(F.max(F.col("label").isNotNull() & F.col("comment").isNotNull()).alias("told"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    of_terms = each.agg(share(n("object"), n("object") + n("data")).alias("relationship_richness"), share(F.count_if("told"), F.count("*")).alias("annotation"))
    deepest = depths(below).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("double").alias("inheritance_depth"))
    wide = [df.unpivot([], df.columns, "metric", "value") for df in (of_classes, of_terms, deepest)]
    return reduce(DataFrame.unionByName, wide).select("metric", F.round("value", 6).alias("value"))
