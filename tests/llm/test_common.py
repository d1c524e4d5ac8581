import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from propensity_spark.llm import common, quality


@pytest.mark.parametrize("kind", [pa.string(), pa.binary()])
@pytest.mark.parametrize("sizes", [
    [], [None], [None] * 700, [0] * 300, [9] * 600, [50, 60, 1, None, 200, 100, 0, 1], [1000], [100, 100, 100], [40, 60, 1]])
def test_slices_bound_rows_and_bytes(monkeypatch, kind, sizes):
    monkeypatch.setattr(common, "BYTES", 100)
    texts = [None if n is None else "x" * n for n in sizes]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts).cast(kind)], ["id", "text"])
    got = list(common.slices(part, 1))
    assert [i for few in got for i in few.column(0).to_pylist()] == list(range(len(texts)))
    for few in got:
        assert 0 < few.num_rows <= common.ROWS
        total = sum(len(x or "") for x in few.column(1).to_pylist())
        assert total <= 100 or few.num_rows == 1


def test_slices_of_a_slice():
    part = pa.RecordBatch.from_arrays([pa.array([None, "aa", "bbb", ""])], ["text"]).slice(1, 3)
    assert [x.column(0).to_pylist() for x in common.slices(part, 0)] == [["aa", "bbb", ""]]


@pytest.mark.parametrize("sample", [1, 7, 500, 2999, 3000, 5000])
def test_lowest_hashes_are_those_of_a_plain_sort(spark, sample):
    ids = spark.range(3000).select(F.col("id"))
    wanted = ids.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(sample)
    assert {r[0] for r in quality._lowest(ids, 2, sample).collect()} == {r[0] for r in wanted.collect()}
    assert quality._lowest(ids.where("false"), 2, sample).count() == 0
