"""Missing values, projections and row subsets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logforge.functions.ordered import Sketches, exact_quantiles

#: Columns that one aggregation takes at most, so that wide tables stay within generated code's limits.
BATCH = 150


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def batches(names: list[str], size: int = BATCH) -> Iterable[list[str]]:
    for k in range(0, len(names), size):
        yield names[k : k + size]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column: both count as missing."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def null_rates(df: DataFrame) -> dict[str, float]:
    """The share of missing values of every column; a row for the driver for each batch of columns."""
    rates: dict[str, float] = {}
    for names in batches(df.columns):
        row = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(str(k)) for k, c in enumerate(names)]).first()
        rates |= {c: row[k] or 0.0 for k, c in enumerate(names)}
    return rates


def drop_sparse(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Without the columns whose share of missing values is strictly over the threshold."""
    rates = null_rates(df)
    return df.select(*[col(c) for c in df.columns if rates[c] <= threshold])


def fit_medians(df: DataFrame, names: list[str] | None = None, exact: bool = True, held: Sketches | None = None) -> dict[str, float]:
    """Medians of numeric columns, 0 for a column without values. held: sketches of these rows, if there are any; NaN counts
    as missing here, so they may not have been made of columns with NaN."""
    names = numeric_columns(df) if names is None else names
    out: dict[str, float] = {}
    for part in batches(names):
        clean = [F.when(~is_missing(df, c), col(c).cast("double")) for c in part]
        if exact:
            found = exact_quantiles(df, dict(zip(part, clean)), (0.5,), held)
            row = [(found[c] or [None])[0] for c in part]
        else:
            row = df.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(str(k)) for k, c in enumerate(clean)]).first()
        out |= {c: row[k] if row[k] is not None else 0.0 for k, c in enumerate(part)}
    return out


def fill(df: DataFrame, numbers: Mapping[str, float], text: str = "Unknown") -> DataFrame:
    """Text columns filled with `text`, numeric ones with fitted values (as doubles); datetimes keep their nulls."""
    strings = set(string_columns(df))

    def filled(c: str) -> Column:
        if c in strings:
            return F.coalesce(col(c), F.lit(text)).alias(c)
        if c in numbers:
            return F.when(is_missing(df, c), F.lit(float(numbers[c]))).otherwise(col(c).cast("double")).alias(c)
        return col(c)

    return df.select(*[filled(c) for c in df.columns])


def fill_numeric(df: DataFrame, how: str, names: list[str] | None = None) -> DataFrame:
    """Numeric columns without nulls, before matrix work: how is zero, mean or median."""
    names = numeric_columns(df) if names is None else names
    if how == "zero":
        values = dict.fromkeys(names, 0.0)
    elif how == "median":
        values = fit_medians(df, names)
    elif how == "mean":
        row = df.agg(*[F.avg(F.when(~is_missing(df, c), col(c))).alias(str(k)) for k, c in enumerate(names)]).first()
        values = {c: row[k] or 0.0 for k, c in enumerate(names)}
    else:
        raise ValueError(how)
    return df.select(*[F.when(is_missing(df, c), F.lit(values[c])).otherwise(col(c).cast("double")).alias(c) if c in values else col(c) for c in df.columns])


def project(df: DataFrame, wanted: list[str], target: str | None = None) -> DataFrame:
    """The wanted columns that exist, in the wanted order; the target always, if the table has it."""
    names = [c for c in wanted if c in df.columns]
    if target is not None and target in df.columns and target not in names:
        names.append(target)
    return df.select(*[col(c) for c in names])


def drop_leakage(df: DataFrame, names: tuple[str, ...] = ("actor_bot_ratio",)) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def variances(df: DataFrame, names: list[str], population: bool = False) -> dict[str, float]:
    out: dict[str, float] = {}
    for part in batches(names):
        row = df.agg(*[(F.var_pop if population else F.var_samp)(col(c)).alias(str(k)) for k, c in enumerate(part)]).first()
        out |= {c: row[k] or 0.0 for k, c in enumerate(part)}
    return out


def drop_constant(df: DataFrame) -> DataFrame:
    """Without numeric columns whose variance isn't over zero."""
    found = variances(df, numeric_columns(df))
    return df.select(*[col(c) for c in df.columns if found.get(c, 1.0) > 0])


#: Words that mark a column worth an outlier test.
KEYWORDS = ("count", "ratio", "velocity", "hour", "value", "amount", "bot", "score")


def key_columns(df: DataFrame, keywords: tuple[str, ...] = KEYWORDS, most: int = 15, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns with a keyword among the words of their name (split at underscores); identifiers, outlier flags
    and `exclude` (the target and what derives from it) left out; of more than `most` those of largest variance."""
    names = [c for c in numeric_columns(df) if not c.endswith("_id") and c != "id" and not c.startswith("outlier_") and c not in exclude
             and set(c.lower().split("_")) & set(keywords)]
    if len(names) > most:
        found = variances(df, names)
        names = sorted(names, key=lambda c: (-found[c], c))[:most]
    return names


#: Subsets that a column's value tells: None stands for the target.
SUBSETS = {"bot_events": (None, 1), "human_events": (None, 0), "weekend_events": ("is_weekend", 1), "programmatic": ("is_programmatic", 1)}


def _in_subset(df: DataFrame, kind: str, target: str, held: Sketches | None = None) -> Column:
    if kind == "high_activity":
        edge = (exact_quantiles(df, {"actor_event_count": F.col("actor_event_count")}, (0.75,), held)["actor_event_count"] or [None])[0]
        return F.col("actor_event_count") >= F.lit(edge)
    column, value = SUBSETS[kind]
    return col(column or target) == value


def subset(df: DataFrame, kind: str, target: str = "actor_is_bot") -> DataFrame:
    """A named subset of rows: bot_events, human_events, high_activity (events at or over the upper quartile of
    actor_event_count), weekend_events, programmatic."""
    return df.where(_in_subset(df, kind, target))


def subset_counts(df: DataFrame, target: str = "actor_is_bot", held: Sketches | None = None) -> DataFrame:
    """(subset, n) of the subsets whose columns df has, all in one read beside that for the quartile. held: sketches of these
    rows, if there are any."""
    kinds = [k for k, c in [*((k, c or target) for k, (c, _) in SUBSETS.items()), ("high_activity", "actor_event_count")] if c in df.columns]
    if not kinds:
        return df.sparkSession.createDataFrame([], "subset string, n long")
    wide = df.agg(*[F.count_if(_in_subset(df, k, target, held)).alias(k) for k in kinds])
    return wide.unpivot([], kinds, "subset", "n")
