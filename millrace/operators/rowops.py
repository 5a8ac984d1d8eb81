"""Row operators: filters, projections, flat-maps, validation and enrichment, all as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterConfig:
    """A configured filter: column, operator (GreaterThan, LessThan, Equals, NotEquals, Contains), value."""

    column: str
    operator: str
    value: object

    def condition(self) -> Column:
        c, v = F.col(self.column), F.lit(self.value)
        made = {"GreaterThan": c > v, "LessThan": c < v, "Equals": c == v, "NotEquals": c != v, "Contains": c.cast("string").contains(F.lit(str(self.value)))}
        if self.operator not in made:
            raise ValueError(f"unknown filter operator {self.operator!r}; known: {', '.join(made)}")
        return made[self.operator]


def filter_rows(df: DataFrame, condition: Column | str | FilterConfig) -> DataFrame:
    """The rows that meet a condition; none gives an empty frame of the same schema. A null condition is not met."""
    return df.where(condition.condition() if isinstance(condition, FilterConfig) else condition)


def select_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns in order; at least one."""
    if not columns:
        raise ValueError("at least one column is needed")
    return df.select(*columns)


def select_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under new names, in the order of the mapping."""
    if not mapping:
        raise ValueError("at least one column is needed")
    return df.select(*(F.col(a).alias(b) for a, b in mapping.items()))


def derive(df: DataFrame, add: dict[str, Column], remove: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns added, then others removed."""
    return df.withColumns(add).drop(*remove)


def transform_rows(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A block given as a function of the frame; it fuses with its neighbours into one stage."""
    return df.transform(function)


def flat_map(df: DataFrame, items: Column, name: str, keep_empty: bool = False) -> DataFrame:
    """Each row once per item of an array; an empty or null array drops the row, or keeps it with null."""
    return df.withColumn(name, (F.explode_outer if keep_empty else F.explode)(items))


def validate(df: DataFrame, id_column: str, data_column: str) -> DataFrame:
    """Adds ``is_valid``: the data is neither null nor empty and the id is not negative. Rows are kept; a null id is not valid."""
    ok = (F.coalesce(F.length(data_column), F.lit(0)) > 0) & (F.col(id_column) >= 0)
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def enrich(df: DataFrame, id_column: str) -> DataFrame:
    """Adds ``category`` by id modulo 3 and ``value``, the id's last three digits as tenths."""
    third = F.col(id_column) % 3
    return df.withColumn("category", F.when(third == 0, "TypeA").when(third == 1, "TypeB").otherwise("TypeC")).withColumn(
        "value", ((F.col(id_column) % 1000).cast("decimal(18,2)") / F.lit(10)).cast("decimal(18,2)")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation (sample), least and greatest value of numeric columns, a row for each."""
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("least", F.min), ("greatest", F.max))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}__{n}").alias(n) for n in ("n", "mean", "sd", "least", "greatest"))) for c in columns))).alias("r")
    return stats.select(rows).select("r.*")


# Tagged items: data and control signals in one stream.


def to_envelope(df: DataFrame, value: Column) -> DataFrame:
    """Each row as a data item: ``kind`` 'data', ``value``, no signal."""
    return df.select(F.struct(F.lit("data").alias("kind"), value.alias("value"), F.lit(None).cast("bigint").alias("signal_id"), F.lit(None).cast("timestamp_ntz").alias("signal_ts")).alias("envelope"))


def map_data(df: DataFrame, function: Callable[[Column], Column], envelope: str = "envelope") -> DataFrame:
    """Maps the value of data items; control signals pass through as they are."""
    e = F.col(envelope)
    return df.withColumn(envelope, e.withField("value", F.when(e["kind"] == "data", function(e["value"])).otherwise(e["value"])))


def data_items(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    return df.where(F.col(envelope)["kind"] == "data")


def control_signals(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    return df.where(F.col(envelope)["kind"] != "data")
