import pytest

from pixelsieve.plans import oracle, queries
from tests.oracle import connect, same

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    same(spark, con, queries.queries()[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


def test_every_name_is_known():
    assert set(SQL) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_texts_are_hashed(spark, tmp_path):
    import numpy as np

    from pixelsieve.functions import hashing

    head = "".join(chr(33 + i * i % 90) for i in range(400))
    texts = [head + "~" * 3000, head + "!~" * 1500, "short", "x", "", None, "ä€" * 200]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.dhash, r.phash) for r in queries.queries()["whole_hashes"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6] and got[4] == (None, None)
    assert got[0][0] != got[1][0] and got[0][1] != got[1][1]
    for i in (0, 1, 2, 3, 6):
        data = texts[i].encode()
        width = int(np.ceil(np.sqrt(len(data))))
        gray = np.frombuffer(data.ljust(-(-len(data) // width) * width, b"\0"), np.uint8).reshape(-1, width)
        assert got[i] == (hashing.dhash_of(gray).hex(), hashing.phash_of(gray).hex())


def test_every_record_is_compared_or_without_hash(spark, small):
    q = queries.queries()
    missing = {(r.source, r.hash_name, r.idx) for r in q["without_hash"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/sample_set.parquet").collect()
    for column, good in (("dhash", lambda r: len(r.v_dhash or b"") == 64), ("phash", lambda r: len(r.v_phash or b"") == 32), ("md5", lambda r: r.v_md5 is not None)):
        assert {i for s, h, i in missing if (s, h) == ("sample_set", column)} == {r.idx for r in rows if not good(r)} != set()
    new = spark.read.parquet(f"{small}/batch_set.parquet").collect()
    left = {r.idx for r in q["remain_dhash"](spark, small).collect()}
    lost = {i for s, h, i in missing if (s, h) == ("batch_set", "dhash")}
    assert lost == {r.idx for r in new if len(r.v_dhash or b"") != 64} and not lost & left
