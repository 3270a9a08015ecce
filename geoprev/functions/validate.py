"""Assertions on arguments, and checks of DataFrame columns in one aggregate.

Each `assert_*` returns True or raises ValueError. Vectors are lists, tuples and 1-d arrays; matrices 2-d arrays; a data frame
is a pandas or Spark DataFrame. None stands for null, None or NaN inside a vector for a missing value.
"""

from __future__ import annotations

import math
import numbers
import os
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exclusive bounds of a 32-bit int that is not the missing value.
INT_LOW, INT_HIGH = -2147483649, 2147483648


def nice_format(x) -> str:
    if x is None:
        return ""
    if is_vector(x):
        v = _list(x)
        return "{" + ", ".join(map(str, v)) + "}" if len(v) != 1 else str(v[0])
    return str(x)


def is_vector(x) -> bool:
    return isinstance(x, (list, tuple, range, pd.Series)) or (isinstance(x, np.ndarray) and x.ndim == 1)


def _list(x) -> list:
    if isinstance(x, np.ndarray):
        return x.ravel().tolist()
    return list(x) if is_vector(x) else [x]


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT


def _number(v) -> bool:
    return isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_))


def _whole(v) -> bool:
    return _number(v) and math.isfinite(v) and abs(v - round(v)) <= 1.5e-8 * max(1.0, abs(v))


def _close(a, b) -> bool:
    if _number(a) and _number(b):
        return abs(a - b) <= 1.5e-8 * max(1.0, abs(a))
    return a == b


def _say(ok: bool, message: str | None, default: str, name: str | None) -> bool:
    if not ok:
        raise ValueError(message or f"{name or 'value'} {default}")
    return True


def _each(test, default: str):
    """An assertion that holds if the test holds for all elements."""

    def check(x, message: str | None = None, name: str | None = None) -> bool:
        return _say(x is not None and all(test(v) for v in _list(x)), message, default, name)

    check.__doc__ = f"x {default}."
    return check


def _whole_value(test, default: str):
    """An assertion on the value as a whole."""

    def check(x, message: str | None = None, name: str | None = None) -> bool:
        return _say(bool(test(x)), message, default, name)

    check.__doc__ = f"x {default}."
    return check


def _all_of(*checks):
    """An assertion that makes several; other arguments go to the last."""

    def check(x, *args, message: str | None = None, name: str | None = None, **more) -> bool:
        for c in checks[:-1]:
            c(x, message=message, name=name)
        return checks[-1](x, *args, message=message, name=name, **more)

    check.__doc__ = "All of: " + ", ".join(c.__doc__ or "" for c in checks)
    return check


assert_null = _whole_value(lambda x: x is None, "must be null")
assert_non_null = _whole_value(lambda x: x is not None, "must not be null")
assert_na = _each(_missing, "must be missing")
assert_non_na = _whole_value(lambda x: x is not None and not any(map(_missing, _list(x))), "must not have missing values")
assert_atomic = _each(lambda v: isinstance(v, (str, numbers.Number, np.generic)) or v is None, "must be atomic")
assert_string = _each(lambda v: isinstance(v, str), "must be strings")
assert_logical = _each(lambda v: isinstance(v, (bool, np.bool_)), "must be logical")
assert_numeric = _each(_number, "must be numeric")
assert_int = _each(_whole, "must be whole numbers")
assert_cpp_int = _each(lambda v: _whole(v) and INT_LOW < v < INT_HIGH, "must be whole numbers of 32 bits")
assert_vector = _whole_value(lambda x: is_vector(x) or isinstance(x, (str, numbers.Number)), "must be a vector")
assert_matrix = _whole_value(lambda x: isinstance(x, np.ndarray) and x.ndim == 2, "must be a matrix")
assert_list = _whole_value(lambda x: isinstance(x, (list, dict)), "must be a list")
assert_named = _whole_value(lambda x: isinstance(x, (Mapping, pd.Series)) and all(isinstance(k, str) and k for k in dict(x)), "must have names")
assert_dataframe = _whole_value(lambda x: isinstance(x, (pd.DataFrame, DataFrame)), "must be a data frame")
assert_single = _whole_value(lambda x: x is not None and len(_list(x)) == 1 and not isinstance(x, Mapping), "must be a single value")
assert_noduplicates = _whole_value(lambda x: len({repr(v) for v in _list(x)}) == len(_list(x)), "must not have duplicates")
assert_increasing = _whole_value(lambda x: all(a <= b for a, b in zip(_list(x), _list(x)[1:])), "must be increasing")
assert_decreasing = _whole_value(lambda x: all(a >= b for a, b in zip(_list(x), _list(x)[1:])), "must be decreasing")
assert_file_exists = _whole_value(lambda x: isinstance(x, (str, os.PathLike)) and os.path.exists(x), "must be an existing file")
assert_2d = _whole_value(lambda x: isinstance(x, (pd.DataFrame, DataFrame)) or (isinstance(x, np.ndarray) and x.ndim == 2), "must have two dimensions")


def assert_class(x, kind, message=None, name=None) -> bool:
    names = {c.__name__ for c in type(x).__mro__}
    return _say(isinstance(x, kind) if isinstance(kind, type) else kind in names, message, f"must be of class {kind}", name)


def assert_pos(x, zero_allowed: bool = True, message=None, name=None) -> bool:
    assert_numeric(x, message, name)
    return _say(all(v > 0 or (zero_allowed and v == 0) for v in _list(x)), message, "must be positive", name)


def assert_bounded(x, left: float = 0, right: float = 1, inclusive_left: bool = True, inclusive_right: bool = True, message=None, name=None) -> bool:
    assert_numeric(x, message, name)
    ok = all((v > left or (inclusive_left and v == left)) and (v < right or (inclusive_right and v == right)) for v in _list(x))
    return _say(ok, message, f"must lie between {left} and {right}", name)


assert_pos_int = _all_of(assert_int, assert_pos)
assert_pos_cpp_int = _all_of(assert_cpp_int, assert_pos)
assert_single_string = _all_of(assert_single, assert_string)
assert_single_logical = _all_of(assert_single, assert_logical)
assert_single_numeric = _all_of(assert_single, assert_numeric)
assert_single_int = _all_of(assert_single, assert_int)
assert_single_cpp_int = _all_of(assert_single, assert_cpp_int)
assert_single_pos = _all_of(assert_single, assert_pos)
assert_single_pos_int = _all_of(assert_single, assert_int, assert_pos)
assert_single_pos_cpp_int = _all_of(assert_single, assert_cpp_int, assert_pos)
assert_single_bounded = _all_of(assert_single, assert_bounded)
assert_vector_logical = _all_of(assert_vector, assert_logical)
assert_vector_numeric = _all_of(assert_vector, assert_numeric)
assert_vector_int = _all_of(assert_vector, assert_int)
assert_vector_pos = _all_of(assert_vector, assert_pos)
assert_vector_pos_int = _all_of(assert_vector, assert_int, assert_pos)
assert_vector_bounded = _all_of(assert_vector, assert_bounded)
assert_vector_string = _all_of(assert_vector, assert_string)
assert_matrix_numeric = _all_of(assert_matrix, assert_numeric)
assert_list_named = _all_of(assert_list, assert_named)


def assert_limit(x, message=None, name=None) -> bool:
    assert_vector_numeric(x, message=message, name=name)
    v = _list(x)
    return _say(len(v) == 2 and v[0] < v[1], message, "must be two increasing numbers", name)


def assert_length(x, n: int, message=None, name=None) -> bool:
    return _say(x is not None and len(_list(x)) == n, message, f"must have length {n}", name)


def assert_same_length(x, y, message=None, name=None) -> bool:
    size = lambda v: 0 if v is None else len(_list(v))
    return _say(size(x) == size(y), message, "must have the same length as the other", name)


def assert_same_length_multiple(*xs, message=None, name=None) -> bool:
    return _say(len({0 if x is None else len(_list(x)) for x in xs}) <= 1, message, "must all have the same length", name)


def assert_eq(x, y, message=None, name=None) -> bool:
    assert_same_length(x, y, message, name)
    return _say(all(_close(a, b) for a, b in zip(_list(x), _list(y))), message, f"must equal {nice_format(y)}", name)


def assert_neq(x, y, message=None, name=None) -> bool:
    assert_same_length(x, y, message, name)
    return _say(not any(_close(a, b) for a, b in zip(_list(x), _list(y))), message, f"must differ from {nice_format(y)}", name)


def _compared(test, word: str):
    def check(x, y, message=None, name=None) -> bool:
        assert_numeric(x, message, name)
        assert_numeric(y, message, "the other")
        a, b = _list(x), _list(y)
        _say(len(b) in (1, len(a)), message, "needs one value or as many to compare with", name)
        return _say(all(test(v, b[i if len(b) > 1 else 0]) for i, v in enumerate(a)), message, f"must be {word} {nice_format(y)}", name)

    check.__doc__ = f"Every x is {word} y, a single value or one for each."
    return check


assert_gr = _compared(lambda a, b: a > b, "greater than")
assert_greq = _compared(lambda a, b: a >= b, "at least")
assert_le = _compared(lambda a, b: a < b, "less than")
assert_leq = _compared(lambda a, b: a <= b, "at most")


def assert_in(x, y, message=None, name=None) -> bool:
    assert_non_null(x, message, name)
    return _say(all(any(_close(a, b) for b in _list(y)) for a in _list(x)), message, f"must be in {nice_format(y)}", name)


def assert_not_in(x, y, message=None, name=None) -> bool:
    return _say(not any(_close(a, b) for a in _list(x) for b in _list(y)), message, f"must not be in {nice_format(y)}", name)


def _shape(x) -> tuple[int, int]:
    assert_2d(x)
    return (x.count(), len(x.columns)) if isinstance(x, DataFrame) else x.shape


def assert_nrow(x, n: int, message=None, name=None) -> bool:
    return _say(_shape(x)[0] == n, message, f"must have {n} rows", name)


def assert_ncol(x, n: int, message=None, name=None) -> bool:
    return _say(_shape(x)[1] == n, message, f"must have {n} columns", name)


def assert_dim(x, shape, message=None, name=None) -> bool:
    return _say(tuple(_shape(x)) == tuple(shape), message, f"must have shape {tuple(shape)}", name)


def assert_square_matrix(x, message=None, name=None) -> bool:
    assert_matrix(x, message, name)
    return _say(x.shape[0] == x.shape[1], message, "must be square", name)


def assert_symmetric_matrix(x, message=None, name=None) -> bool:
    assert_square_matrix(x, message, name)
    return _say(np.allclose(x, x.T), message, "must be symmetric", name)


def column_rules(low: float | None = None, high: float | None = None, whole: bool = False, required: bool = False):
    """A condition on a column: bounds, whole numbers, no NULL; NULL passes unless it is required."""

    def rule(c: Column) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (c >= low)
        if high is not None:
            ok = ok & (c <= high)
        if whole:
            ok = ok & (c == F.floor(c))
        return F.coalesce(ok, F.lit(True)) & (c.isNotNull() if required else F.lit(True))

    return rule


def check_columns(df: DataFrame, rules: dict) -> DataFrame:
    """One row: for each column, whether its rule holds everywhere. One pass, one aggregate."""
    return df.agg(*[F.coalesce(F.bool_and(rule(F.col(c))), F.lit(True)).alias(c) for c, rule in rules.items()])


def assert_columns(df: DataFrame, rules: dict) -> bool:
    row = check_columns(df, rules).first().asDict()
    bad = [c for c, ok in row.items() if not ok]
    return _say(not bad, None, f"columns break their rules: {bad}", "table")


ORDER = "part int, n long, first double, last double, up boolean, down boolean"


def check_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row: whether a numeric column increases and decreases (equal neighbours allowed) in the order of others, and has no duplicates.

    Ranges of the order are checked each in one task, batch by batch, and send their first and last value; these, a row a range, are
    compared with their neighbours'. Duplicates are found by a grouped count. A NULL or NaN breaks both orders; an empty table breaks nothing.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import Window

    def run(batches):
        n, first, last, up, down = 0, None, None, True, True
        for b in batches:
            x = b.column("v").to_numpy(zero_copy_only=False).astype(float)
            if not len(x):
                continue
            step = np.diff(x if last is None else np.append(last, x))
            ok = not np.isnan(x).any()
            up, down = bool(up and ok and (step >= 0).all()), bool(down and ok and (step <= 0).all())
            first, last, n = x[0] if n == 0 else first, x[-1], n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((TaskContext.get().partitionId(), n, first, last, up, down), (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()))], names=["part", "n", "first", "last", "up", "down"])

    value = F.col(column).cast("double").alias("v")
    ranges = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value).repartitionByRange(*[f"o{i}" for i in range(len(order))]).sortWithinPartitions(*[f"o{i}" for i in range(len(order))]).mapInArrow(run, ORDER)
    before = F.lag("last").over(Window.orderBy("part"))
    sides = ranges.withColumn("before", before).agg(
        F.coalesce(F.bool_and(F.col("up") & F.coalesce(F.col("first") >= F.col("before"), F.lit(True))), F.lit(True)).alias("increasing"),
        F.coalesce(F.bool_and(F.col("down") & F.coalesce(F.col("first") <= F.col("before"), F.lit(True))), F.lit(True)).alias("decreasing"))
    return sides.join(check_unique(df, [column]))


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether no values of the columns together come twice (NULL counts as a value)."""
    return df.groupBy(*columns).count().agg(F.coalesce(F.bool_and(F.col("count") == 1), F.lit(True)).alias("noduplicates"))
