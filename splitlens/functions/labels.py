"""Labels as data: one canonical pair of arrays for scalar and multitask labels.

``label_num`` (array<double>) holds the numeric values, ``label_key`` (array<string>) one spelling per value, so
that ``1``, ``1.0``, ``'1'`` and ``true`` are equal and ``'x'`` only equals ``'x'``. A missing scalar label is an array
with one null, never a null array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of a missing label, and of splits.
MISSING = ["", "nan", "na", "null"]
SPLITS = {"train": "train", "val": "valid", "valid": "valid", "test": "test"}
SPLIT_BITS = {"train": 1, "valid": 2, "test": 4}

_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_BLANK = " \t\n\r\x0b\x0c"


def numeric(value: Column) -> Column:
    """The number that a text spells, else null. Digits may be grouped by single underscores."""
    text = F.btrim(value, F.lit(_BLANK))
    plain = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
    endless = F.when(text.rlike(r"(?i)^[+-]?inf(inity)?$"), F.when(F.startswith(text, F.lit("-")), float("-inf")).otherwise(float("inf")))
    return F.coalesce(plain, endless) + F.lit(0.0)


def coerced(value: Column, kind: T.DataType | None = None) -> tuple[Column, Column]:
    """Number and key of one label. Text is stripped and read as a number where it spells one."""
    if kind is None or isinstance(kind, T.StringType):
        text = F.btrim(value.cast("string"), F.lit(_BLANK))
        present = F.when(~F.lower(text).isin(MISSING), text)
        number = numeric(present)
        return number, F.coalesce(number.cast("string"), present)
    number = value.cast("double")
    number = F.when(~F.isnan(number), number + F.lit(0.0))
    return number, number.cast("string")


def with_labels(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Adds ``label_num`` and ``label_key``. One column that is an array is taken as it is, flattened."""
    kinds = {f.name: f.dataType for f in df.schema}
    if len(label_cols) == 1 and isinstance(kinds[label_cols[0]], T.ArrayType):
        kind, value = kinds[label_cols[0]], F.col(label_cols[0])
        while isinstance(kind.elementType, T.ArrayType):
            kind, value = kind.elementType, F.flatten(value)
        value = F.coalesce(value, F.array(F.lit(None).cast(kind.elementType)))
        return df.withColumn("label_num", F.transform(value, lambda x: coerced(x, kind.elementType)[0])).withColumn("label_key", F.transform(value, lambda x: coerced(x, kind.elementType)[1]))
    pairs = [coerced(F.col(c), kinds[c]) for c in label_cols]
    return df.withColumn("label_num", F.array(*[n for n, _ in pairs])).withColumn("label_key", F.array(*[k for _, k in pairs]))


def split_name(value: Column) -> Column:
    """train, valid or test; null for anything else."""
    text = F.lower(F.btrim(value.cast("string"), F.lit(_BLANK)))
    out = F.lit(None).cast("string")
    for spelling, name in SPLITS.items():
        out = F.when(text == spelling, name).otherwise(out)
    return out


def split_bit(split: Column) -> Column:
    return F.when(split == "train", 1).when(split == "valid", 2).when(split == "test", 4).otherwise(0)


def sequence(value: Column) -> Column:
    """Upper case without white space; null is the empty sequence, which counts as a value."""
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"\s+", "")


def classification_delta(a: Column, b: Column) -> Column:
    """Differences of whole parts by position; null where either side has no number."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: _whole(x["a"]) - _whole(x["b"]))


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def regression_delta(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] - x["b"])


def exceeds(delta: Column, thresholds: Column) -> Column:
    """Whether any position reaches its threshold. Positions beyond the thresholds use the last one; a null or
    zero threshold and a null difference never count."""
    last = F.size(thresholds) - 1
    return F.coalesce(
        F.exists(
            F.transform(delta, lambda d, i: F.struct(F.abs(d).alias("d"), F.get(thresholds, F.least(i, last)).alias("t"))),
            lambda x: F.coalesce((x["t"] != 0) & (x["d"] >= x["t"]), F.lit(False)),
        ),
        F.lit(False),
    )


def slug(value: Column) -> Column:
    """Characters that file names don't take become single dashes; null if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.btrim(value, F.lit(_BLANK)), r"[^A-Za-z0-9._-]+", "-"), "-{2,}", "-")
    return F.nullif(F.btrim(dashed, F.lit("-._")), F.lit(""))
