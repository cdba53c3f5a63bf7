"""Value coercion: sentinels, numbers, booleans, dates, safe names, normal forms. All return null for what can't be read."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that stand for a missing value.
NULL_WORDS = ("n/a", "na", "null", "-", "none", "#n/a", "nan", "undefined", "미정", "해당없음")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"
DATE_FORMATS = (
    "yyyy-M-d'T'H:m:s[.SSSSSS]", "yyyy-M-d'T'H:m", "yyyy-M-d H:m:s[.SSSSSS]", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s[.SSSSSS]", "yyyy/M/d H:m", "yyyy/M/d",
    "yyyy.M.d H:m:s[.SSSSSS]", "yyyy.M.d", "yyyyMMdd", "yyyyMMddHHmmss",
)
TWO_PARTS = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
#: Values that a column of few distinct ones holds as data though they stand for a missing value elsewhere, and how few.
DASH, DASH_COLUMN_VALUES = "-", 4


def without_sentinel(value: Column, keep_dash: bool = False) -> Column:
    """Trimmed value, null if it is empty or stands for a missing one; keep_dash keeps '-'."""
    trimmed = F.trim(value)
    words = [w for w in NULL_WORDS if not (keep_dash and w == "-")]
    return F.when((F.length(trimmed) > 0) & ~F.lower(trimmed).isin(words), trimmed)


def to_number(value: Column) -> Column:
    """double of a decimal, exponent, inf or nan notation, digits grouped by _ included."""
    trimmed = F.lower(F.trim(value))
    return F.when(trimmed.rlike(NUMBER), F.regexp_replace(trimmed, "_", "").try_cast("double"))


def to_integer(value: Column, low: int | None = None, high: int | None = None) -> Column:
    """bigint, decimals truncated; null outside [low, high]."""
    number = to_number(value)
    whole = F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long"))
    ok = F.lit(True)
    ok = ok & (whole >= low) if low is not None else ok
    ok = ok & (whole <= high) if high is not None else ok
    return F.when(ok, whole)


def to_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_timestamp(value: Column, order: str | None = None) -> Column:
    """First format that reads it. A T form with an offset or Z becomes the time in UTC. Day and month before a year, parted by one of / . -, are
    ambiguous with both in 1..12: null unless order is dmy or mdy (any other counts as unset), and then read by that order alone."""
    zone = r"^(\d{4}-\d\d-\d\dT.*?)(?:Z|([+-])(\d\d):(\d\d))$"
    given = F.trim(value)
    text = F.regexp_replace(given, zone, "$1")
    sign, hours, minutes = (F.regexp_extract(given, zone, k) for k in (2, 3, 4))
    behind = F.when(sign == "-", 1).otherwise(-1) * (hours.try_cast("int") * 60 + minutes.try_cast("int"))
    read = lambda of, form: F.try_to_timestamp(of, F.lit(form))
    first, second, year = (F.regexp_extract(text, TWO_PARTS, k) for k in (1, 3, 4))
    by_day, by_month = (read(F.concat_ws("-", year, month, day), "yyyy-M-d") for month, day in ((second, first), (first, second)))
    both = first.try_cast("int").between(1, 12) & second.try_cast("int").between(1, 12)
    parted = by_day if order == "dmy" else by_month if order == "mdy" else F.when(~both, F.coalesce(by_day, by_month))
    found = F.when(text.rlike(TWO_PARTS), parted).otherwise(F.coalesce(*[read(text, f) for f in DATE_FORMATS])).cast("timestamp_ntz")
    return F.when(sign == "", found).otherwise(found + F.make_dt_interval(F.lit(0), F.lit(0), behind))


def normal_value(value: Column) -> Column:
    """A value without a byte order mark, outer white space and runs of white space within."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, "\ufeff", ""), r"(?U)\s+", " "))


def dash_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, keeps_dash: whether - is data there, that is it stands among at most DASH_COLUMN_VALUES distinct non-empty values.

    All rows are read; distinct values are counted after a shuffle by column and value, so no task holds a column.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns]))
    values = df.select(cells.alias("x")).select("x.column", "x.value").where("value <> ''").distinct()
    counted = values.groupBy("column").agg(F.count("*").alias("n_distinct"), F.bool_or(F.col("value") == DASH).alias("dash"))
    return counted.select("column", "n_distinct", (F.col("dash") & (F.col("n_distinct") <= DASH_COLUMN_VALUES)).alias("keeps_dash"))


def canonical(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with value, the column's normal value or what names (alias, canon) call it, and unknown: whether names lack it. Null stays null and is not unknown."""
    own = df.withColumn("value", normal_value(F.col(column)))
    joined = own.join(names.select(F.col("alias").alias("value"), "canon"), "value", "left")
    return joined.withColumn("unknown", F.col("canon").isNull() & F.col("value").isNotNull()).withColumn("value", F.coalesce("canon", "value")).drop("canon")


def safe_local(value: Column) -> Column:
    """A part of a local name: every character that is no letter, digit, _ or - becomes _."""
    return F.regexp_replace(value, r"(?U)[^\w-]", "_")


def safe_iri(value: Column) -> Column:
    """A local name for an IRI: a run of unsafe characters becomes one _."""
    return F.regexp_replace(value, r"(?U)[^\w-]+", "_")


def local_name(iri: Column) -> Column:
    """After the last #; only without one, after the last /; else unchanged."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).when(iri.contains("/"), F.substring_index(iri, "/", -1)).otherwise(iri)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def normal_key(value: Column, compatibility: bool = False) -> Column:
    """A key without case, separators and, with compatibility, full-width and similar forms."""
    return F.regexp_replace(F.lower(F.trim(nfkc(value) if compatibility else value)), "[-_. –—]", "")


def trigrams(value: Column) -> Column:
    """Distinct 3-grams of a text; a shorter text is one gram."""
    n = F.length(value)
    return F.when(n < 3, F.array(value)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(value, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
