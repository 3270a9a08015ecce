import numpy as np
import pandas as pd
import pytest

from geoprev.functions import validate as V

HOLD = [
    (V.assert_null, (None,)), (V.assert_non_null, (5,)), (V.assert_na, ([None, float("nan")],)),
    (V.assert_non_na, ([1, 2],)), (V.assert_atomic, ([1, "a"],)), (V.assert_string, (["a", "b"],)), (V.assert_logical, ([True, False],)), (V.assert_numeric, ([1, 2.5],)),
    (V.assert_int, ([1, 5.0, 1e12],)), (V.assert_cpp_int, ([2147483647, -2147483648],)), (V.assert_pos, ([0, 1],)), (V.assert_pos, ([1], False)), (V.assert_pos_int, ([0, 3],)), (V.assert_pos_cpp_int, ([7],)),
    (V.assert_vector, ([1, 2],)), (V.assert_matrix, (np.eye(2),)), (V.assert_list, ([1],)), (V.assert_named, ({"a": 1},)), (V.assert_dataframe, (pd.DataFrame(),)), (V.assert_class, (1.0, float)), (V.assert_class, (1.0, "float")),
    (V.assert_single, (4,)), (V.assert_single_string, ("foo",)), (V.assert_single_logical, (True,)), (V.assert_single_numeric, (1.5,)), (V.assert_single_int, (3,)), (V.assert_single_cpp_int, (3,)),
    (V.assert_single_pos, (0,)), (V.assert_single_pos_int, (3,)), (V.assert_single_pos_cpp_int, (3,)), (V.assert_single_bounded, (0.5,)),
    (V.assert_vector_logical, ([True],)), (V.assert_vector_numeric, ([1.0],)), (V.assert_vector_int, ([1],)), (V.assert_vector_pos, ([1],)), (V.assert_vector_pos_int, ([1],)), (V.assert_vector_bounded, ([0, 1],)), (V.assert_vector_string, (["a"],)),
    (V.assert_matrix_numeric, (np.eye(3),)), (V.assert_list_named, ({"a": 1},)), (V.assert_limit, ([1, 2],)), (V.assert_eq, ([1, 2], [1.0, 2.0])), (V.assert_neq, ([1, 2], [2, 3])),
    (V.assert_gr, ([2, 3], 1)), (V.assert_greq, ([1, 3], [1, 2])), (V.assert_le, (1, 2)), (V.assert_leq, ([1, 2], 2)), (V.assert_bounded, ([0, 1],)), (V.assert_in, ([1, 2], [1, 2, 3])), (V.assert_not_in, (5, [1, 2])),
    (V.assert_length, ([1, 2], 2)), (V.assert_same_length, ([1], [2])), (V.assert_same_length, (None, None)), (V.assert_same_length_multiple, ([1], [2], [3])), (V.assert_2d, (np.eye(2),)), (V.assert_nrow, (np.zeros((2, 3)), 2)),
    (V.assert_ncol, (np.zeros((2, 3)), 3)), (V.assert_dim, (np.zeros((2, 3)), (2, 3))), (V.assert_square_matrix, (np.eye(2),)), (V.assert_symmetric_matrix, (np.eye(2),)), (V.assert_noduplicates, ([1, 2],)),
    (V.assert_file_exists, (__file__,)), (V.assert_increasing, ([1, 1, 2],)), (V.assert_decreasing, ([2, 1, 1],)),
]
FAIL = [
    (V.assert_null, (5,)), (V.assert_non_null, (None,)), (V.assert_na, ([None, 1],)), (V.assert_non_na, ([1, float("nan")],)), (V.assert_atomic, ([[1]],)), (V.assert_string, ([1],)), (V.assert_logical, ([1],)), (V.assert_numeric, (["1"],)),
    (V.assert_numeric, ([True],)), (V.assert_int, ([0.5],)), (V.assert_cpp_int, ([2147483648],)), (V.assert_cpp_int, ([-2147483649],)), (V.assert_pos, ([-1],)), (V.assert_pos, ([0], False)), (V.assert_pos_int, ([0.5],)), (V.assert_pos_cpp_int, ([-1],)),
    (V.assert_vector, (np.eye(2),)), (V.assert_matrix, ([1],)), (V.assert_list, (1,)), (V.assert_named, ([1],)), (V.assert_dataframe, (1,)), (V.assert_class, (1.0, "int")),
    (V.assert_single, ([1, 2],)), (V.assert_single_string, (1,)), (V.assert_single_logical, (1,)), (V.assert_single_numeric, ("a",)), (V.assert_single_int, (0.5,)), (V.assert_single_cpp_int, (3e9,)), (V.assert_single_pos, (-1,)), (V.assert_single_pos_int, ([1, 2],)),
    (V.assert_single_bounded, (1.5,)), (V.assert_vector_numeric, (np.eye(2),)), (V.assert_vector_int, ([0.5],)), (V.assert_vector_bounded, ([0, 2],)), (V.assert_vector_string, ([1],)), (V.assert_matrix_numeric, (np.array([["a"]]),)), (V.assert_list_named, ([1],)),
    (V.assert_limit, ([2, 1],)), (V.assert_limit, ([1, 2, 3],)), (V.assert_eq, ([1, 2], [1, 3])), (V.assert_eq, ([1], [1, 2])), (V.assert_neq, ([1, 2], [1, 3])), (V.assert_gr, ([1, 3], 1)), (V.assert_gr, ([1, 2, 3], [1, 2])), (V.assert_greq, (0, 1)),
    (V.assert_le, (2, 2)), (V.assert_leq, (3, 2)), (V.assert_bounded, ([0], 0, 1, False)), (V.assert_bounded, ([1], 0, 1, True, False)), (V.assert_in, (5, [1, 2])), (V.assert_in, (None, [1])), (V.assert_not_in, (1, [1, 2])),
    (V.assert_length, (None, 0)), (V.assert_same_length, ([1], [1, 2])), (V.assert_same_length_multiple, ([1], [1, 2])), (V.assert_2d, ([1],)), (V.assert_nrow, (np.eye(2), 3)), (V.assert_ncol, (np.eye(2), 3)), (V.assert_dim, (np.eye(2), (2, 3))),
    (V.assert_square_matrix, (np.zeros((2, 3)),)), (V.assert_symmetric_matrix, (np.array([[0, 1], [2, 0]]),)), (V.assert_noduplicates, ([1, 1],)), (V.assert_file_exists, ("/no/such",)), (V.assert_increasing, ([2, 1],)), (V.assert_decreasing, ([1, 2],)),
]


@pytest.mark.parametrize(("f", "args"), HOLD)
def test_holds(f, args):
    assert f(*args) is True


@pytest.mark.parametrize(("f", "args"), FAIL)
def test_fails(f, args):
    with pytest.raises(ValueError):
        f(*args)


def test_messages():
    assert V.nice_format(None) == "" and V.nice_format(5) == "5" and V.nice_format([1, 2, 3]) == "{1, 2, 3}"
    with pytest.raises(ValueError, match="own words"):
        V.assert_pos(-1, message="own words")
    with pytest.raises(ValueError, match="radius must be positive"):
        V.assert_pos(-1, name="radius")


def test_columns(spark):
    d = spark.createDataFrame([(1.0, 5), (None, 2)], "a double, b int")
    assert V.check_columns(d, {"a": V.column_rules(0, 2), "b": V.column_rules(high=4)}).first().asDict() == {"a": True, "b": False}
    assert V.assert_columns(d, {"a": V.column_rules(0, 2)})
    with pytest.raises(ValueError, match="'a'"):
        V.assert_columns(d, {"a": V.column_rules(required=True)})


def test_order_of_columns(spark):
    import random

    from geoprev.functions import validate as V

    r = random.Random(5)
    for values in ([], [3.0], [1.0, 2.0, 2.0, 5.0], [5.0, 5.0, 1.0], [1.0, 3.0, 2.0], [float(i) for i in range(300)], [*map(float, range(200)), 150.0, *map(float, range(200, 300))], [1.0, None, 2.0]):
        rows = list(enumerate(values))
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "i int, v double").repartition(5)
        got = V.check_order(df, "v", ["i"]).first()
        whole = None not in values
        assert got.increasing == (whole and all(a <= b for a, b in zip(values, values[1:])))
        assert got.decreasing == (whole and all(a >= b for a, b in zip(values, values[1:])))
        assert got.noduplicates == (len(set(values)) == len(values))
