"""Readers and writers: Parquet tables, string-typed CSV, duplicate files, N-Triples, property-graph CSV."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A line of N-Triples: white space between terms may be absent, and a comment may follow.
NT_NODE = r'<[^<>"\s]*>|_:[^\s<>"]*[^\s<>".]'
NT_LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>"\s]*>)?'
NT_LINE = rf'^\s*({NT_NODE})\s*<([^<>"\s]*)>\s*({NT_NODE}|{NT_LITERAL})\s*\.\s*(?:#.*)?$'
NT_NOTHING = r"^\s*(?:#.*)?$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, lines_in_cells: bool = True) -> DataFrame:
    """A CSV table with a header, every cell a string; a byte order mark in the first name is dropped.

    Quoted cells may hold commas, line ends and doubled quotes; backslashes are plain. Where no cell holds a line end, lines_in_cells=False
    lets Spark split a large file among tasks.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", lines_in_cells).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def distinct_files(spark: SparkSession, path: str, preferred: list[str] | None = None) -> DataFrame:
    """One path for each distinct file content, preferred names first, else the first by name: path, copies."""
    files = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("digest"))
    name = F.substring_index("path", "/", -1)
    rank = F.row_number().over(Window.partitionBy("digest").orderBy((~name.isin(preferred or [""])).cast("int"), name))
    held = files.select("path", rank.alias("rank"), F.count("*").over(Window.partitionBy("digest")).alias("copies"))
    return held.where("rank = 1").select("path", "copies")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples s, p, o, o_kind, o_dt, o_lang of N-Triples files, escapes decoded; comments are skipped, and malformed lines too, which malformed_ntriples returns."""
    part = lambda k: F.regexp_extract("value", NT_LINE, k)
    rows = spark.read.text(path).where(F.col("value").rlike(NT_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("raw"))
    literal = F.col("raw").startswith('"')
    body = _decoded(F.regexp_extract("raw", r'^"((?:[^"\\]|\\.)*)"', 1))
    bare = lambda c: _decoded(F.regexp_replace(c, "^<|>$", ""))
    return rows.select(
        bare("s").alias("s"),
        _decoded(F.col("p")).alias("p"),
        F.when(literal, body).otherwise(bare("raw")).alias("o"),
        F.when(literal, "lit").when(F.col("raw").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.nullif(F.regexp_extract("raw", r"\^\^<([^>]*)>$", 1), F.lit("")).alias("o_dt"),
        F.nullif(F.regexp_extract("raw", r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("o_lang"),
    ).distinct()


def malformed_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """path, value of the lines of N-Triples files that are neither a triple nor a comment nor blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.where(~F.col("value").rlike(NT_LINE) & ~F.col("value").rlike(NT_NOTHING))


#: Escapes of N-Triples by their letter.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
ESCAPE = r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"


def _decoded(text: Column) -> Column:
    """text with escapes read from left to right, in one pass; an unknown one stays as it is."""

    def read(part: Column) -> Column:
        letter = F.substring(part, 2, 1)
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv]), letter)
        code = F.when(F.length(part) > 2, F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32"))
        return F.when(part.startswith("\\"), F.coalesce(F.when(letter.isin("u", "U"), code).otherwise(known), part)).otherwise(part)

    return F.when(text.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ESCAPE), F.lit(0)), read), "")).otherwise(text)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line, column value, for each of triples (s, p, o, o_kind and, if there, o_dt and o_lang); a subject that starts with _: is a blank node."""
    body = F.col("o")
    for sign, code in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        body = F.replace(body, F.lit(sign), F.lit(code))
    told = lambda c, text: F.coalesce(text(F.col(c)), F.lit("")) if c in triples.columns else F.lit("")
    tag = told("o_lang", lambda x: F.concat(F.lit("@"), x))
    kind = F.when(tag != "", tag).otherwise(told("o_dt", lambda x: F.concat(F.lit("^^<"), x, F.lit(">"))))
    named = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    term = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), body, F.lit('"'), kind)).when(F.col("o_kind") == "bnode", F.col("o")).otherwise(named("o"))
    return triples.select(F.concat(named("s"), F.lit(" <"), "p", F.lit("> "), term, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.text(path)


def write_property_graph(nodes: DataFrame, rels: DataFrame, path: str) -> None:
    """CSV folders nodes and relationships; arrays and maps as JSON."""
    nodes.select(*[F.to_json(c).alias(c) if not isinstance(nodes.schema[c].dataType, type(nodes.schema["uri"].dataType)) else F.col(c) for c in nodes.columns]).write.option("header", True).csv(f"{path}/nodes")
    rels.write.option("header", True).csv(f"{path}/relationships")


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of the program as a table with the named and typed columns, no row at all included.

    The plan holds them as a local relation of known size, so a join broadcasts them without a job; rows that go through an RDD have no size, and
    the other side would be shuffled.
    """
    schema = StructType.fromDDL(columns)
    return spark.createDataFrame(pa.table({f.name: pa.array([r[k] for r in rows]) for k, f in enumerate(schema)}), schema)
