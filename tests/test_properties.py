"""Properties that hold for any input."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import metrics as M
from tidegauge.operators import ranking as R
from tidegauge.operators import splits as S

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.tuples(st.integers(-3, 3), st.floats(-5, 5, width=16)), min_size=1, max_size=40)


@few
@given(numbers)
def test_ranks_sum_to_n_times_n_plus_one_over_two(spark, rows):
    df = spark.createDataFrame([(float(a), b) for a, b in rows], "a double, b double")
    total = R.average_rank(df, "a").agg(F.sum("rank")).first()[0]
    assert total == len(rows) * (len(rows) + 1) / 2


@few
@given(numbers)
def test_spearman_is_symmetric_and_bounded(spark, rows):
    df = spark.createDataFrame([(float(a), b) for a, b in rows], "a double, b double")
    ab = M.spearman(df, "a", "b", degenerate=0.0).first()["spearman"]
    ba = M.spearman(df, "b", "a", degenerate=0.0).first()["spearman"]
    assert abs(ab - ba) < 1e-9 and abs(ab) <= 1 + 1e-9


@few
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_kappa_of_equal_grades_is_one(spark, grades):
    df = spark.createDataFrame([(g, g) for g in grades], "g int, p int")
    assert M.quadratic_kappa(M.confusion_matrix(df, "g", "p")).first()["qwk"] == 1.0


@few
@given(st.integers(1, 60), st.floats(0.05, 0.95))
def test_split_parts_are_disjoint_and_complete(spark, n, fraction):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(n)], "k int, label string")
    rows = S.stratified_split(df, "label", ["k"], test_fraction=fraction).collect()
    assert sorted(r.k for r in rows) == list(range(n)) and {r.split for r in rows} <= {"train", "test"}
