"""Column lists, schema checks and group labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that stand for a missing and for an unseen category.
NULL_LABEL = "__nan__"
UNKNOWN_LABEL = "__unknown__"
GLOBAL_GROUP = "global"
NOISE_SUFFIX = "_noise"


def unique(names: Iterable[str]) -> list[str]:
    """Names without repeats, first occurrence kept."""
    return list(dict.fromkeys(names))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise if any name is missing; the frame itself is passed through."""
    missing = [c for c in unique(names) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_columns(df: DataFrame, features: Sequence[str], targets: Sequence[str] = ()) -> DataFrame:
    """Requested features and targets that exist, once each, in the order asked for."""
    return df.select(*[c for c in unique([*features, *targets]) if c in df.columns])


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def numeric_only(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The numeric and boolean columns among ``names``; none at all is an error."""
    numeric = set(numeric_columns(df))
    kept = [c for c in unique(names) if c in numeric]
    if not kept:
        raise ValueError("no numeric or boolean column among: " + ", ".join(names))
    return kept


def feature_target_lists(
    df: DataFrame, features: Sequence[str], targets: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Numeric feature and target names; a column that is a target is not also a feature."""
    numeric = set(numeric_columns(df))
    target_names = [c for c in unique(targets) if c in numeric]
    taken = set(target_names)
    feature_names = [c for c in unique(features) if c in numeric and c not in taken]
    return feature_names, target_names


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as double."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        column = column.cast("int")
    return column.cast("double")


def quoted(name: str) -> str:
    """A column name as it is written inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def double_sql(df: DataFrame, name: str) -> str:
    """``as_double`` as SQL text; frames of hundreds of columns are built from one list of texts."""
    inner = f"int({quoted(name)})" if isinstance(df.schema[name].dataType, T.BooleanType) else quoted(name)
    return f"double({inner})"


def label_text(name: str) -> Column:
    """The category as text, with a label of its own for NULL."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_LABEL))


def group_id(groups: Sequence[str]) -> Column:
    """One readable text per series: the group columns joined by ``_``, or ``global`` without any.

    Different series may share it; it is for output, never a key.
    """
    if not groups:
        return F.lit(GLOBAL_GROUP)
    return F.concat_ws("_", *[label_text(c) for c in groups])


def series_key(groups: Sequence[str]) -> Column:
    """The group columns themselves as one value to group, partition and join by; NULL equals NULL in it."""
    return F.struct(*groups) if groups else F.lit(GLOBAL_GROUP)


def series_label(groups: Sequence[str]) -> Column:
    """As ``group_id``, but no two series share a text: an underscore or backslash inside one of several parts, and
    a text that looks like the label of NULL, are marked by a backslash."""
    if not groups:
        return F.lit(GLOBAL_GROUP)
    parts = []
    for c in groups:
        text = F.col(c).cast("string")
        if len(groups) > 1:
            text = F.regexp_replace(text, r"([_\\])", r"\\$1")
        else:
            text = F.when(text.rlike(rf"^\\*{NULL_LABEL}$"), F.concat(F.lit("\\"), text)).otherwise(text)
        parts.append(F.coalesce(text, F.lit(NULL_LABEL)))
    return F.concat_ws("_", *parts)


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal columns, NULL equal to NULL, which have one column each in the result. The two frames share no
    other column."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in names})
    test = F.lit(True)
    for c in names:
        test = test & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    joined = left.join(renamed, test, how)
    if how == "full":
        joined = joined.withColumns({c: F.coalesce(c, f"_right_{c}") for c in names})
    return joined.drop(*[f"_right_{c}" for c in names])


def noise_rename(df: DataFrame) -> DataFrame:
    """Every ``x_noise`` column takes the place and name of ``x``."""
    if not any(c.endswith(NOISE_SUFFIX) for c in df.columns):
        return df
    noisy = {c.removesuffix(NOISE_SUFFIX): c for c in df.columns if c.endswith(NOISE_SUFFIX)}
    replaced = [
        f"{quoted(noisy[c])} AS {quoted(c)}" if c in noisy else quoted(c)
        for c in df.columns
        if not c.endswith(NOISE_SUFFIX)
    ]
    added = [f"{quoted(c)} AS {quoted(base)}" for base, c in noisy.items() if base not in df.columns]
    return df.selectExpr(*replaced, *added)


def expand_steps(steps: int | Sequence[int] | None, default: int | None = None) -> list[int]:
    """Steps to build: 1..n for a number, a list as it is, 1..``default`` for None; only step 1 where nothing positive is given."""
    if steps is not None and not isinstance(steps, int):
        return list(steps)
    last = default if steps is None else steps
    return list(range(1, max(last or 0, 1) + 1))
