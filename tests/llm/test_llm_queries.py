import pytest

from pixelsieve.llm import queries
from tests.oracle import connect, same

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    same(spark, con, queries.queries()[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


def test_rates_say_what_they_are_of(spark, small):
    assert {(r.hash_name, r.asked) for r in queries.queries()["p1_wrong"](spark, small).collect()} == {(h, a) for h in queries.HASHES for a in ("knn_probe", "idx % 50 = 0")}
    assert [r.remainder_bits for r in queries.queries()["p6_error_rates"](spark, small).orderBy("bits").collect()] == [4, 8, 12, 32]
