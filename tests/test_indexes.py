"""Indexes give what the scans give, and read less."""
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import search as se
from propensity_spark.operators.indexes import PageIndex, TextIndex, _pieces
from tests.conftest import rows


@pytest.fixture(scope="module")
def listing(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 5.0, 5.0, 5.0, round(rng.random() * 9, 1)]), rng.choice("abc")) for i in range(700)]
    return spark.createDataFrame(data, "id int, score double, kind string").cache()


@pytest.mark.parametrize("sort", [[("score", True)], [("score", False)], [("kind", True), ("score", False)], []])
def test_any_page_equals_the_offset_form(listing, tmp_path, sort):
    index = PageIndex.build(listing, str(tmp_path), sort, "id", 6)
    for number, size in ((1, 10), (2, 33), (9, 70), (10, 70), (11, 70), (1, 700), (3, 300), (50, 20)):
        assert rows(index.page(number, size)) == rows(se.page(listing, sort, "id", number, size)), (number, size)


def test_a_page_reads_its_ranges_only(listing, tmp_path):
    index = PageIndex.build(listing, str(tmp_path), [("score", True)], "id", 8)
    want = rows(index.page(20, 20))
    ranges = sorted(glob.glob(f"{tmp_path}/rows/_range=*"), key=lambda p: int(p.rpartition("=")[2]))
    assert len(ranges) == 8
    for folder in ranges[:4]:  # page 20 lies in the second half
        _spoil(folder)
    assert rows(index.page(20, 20)) == want


def _spoil(folder):
    for name in glob.glob(f"{folder}/*.parquet"):
        crc = os.path.join(folder, f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        with open(name, "wb") as file:
            file.write(b"not parquet")


TEXTS = ["Alpha Beta", "alphabet soup", "100% sure", "under_score", "back\\slash", "ÉCLAIR au café", "", None, "ab", "a%b_c",
         "Ostraße", "needle in hay", "NEEDLE IN HAY", "x" * 3000 + "tail"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    data = [(i, t, f"note {i % 3}", float(i)) for i, t in enumerate(TEXTS * 4)]
    df = spark.createDataFrame(data, "id int, body string, note string, amount double").repartition(5)
    columns = ["body", "note", "amount"]
    return df, TextIndex.build(df, str(tmp_path_factory.mktemp("index")), columns, rows_per_range=8), columns


@pytest.mark.parametrize("text", ["", "a", "ab", "alpha", "ALPHA", "100%", "r_s", "k\\s", "éclair", "CAFÉ", "raße", "needle in hay",
                                  "note 2", "3.00", "nowhere", "xxxx", "xtail", "pha be"])
def test_a_search_equals_the_scan(texts, text):
    df, index, columns = texts
    assert sorted(rows(index.search(text)), key=repr) == sorted(rows(se.search_any(df, text, columns)), key=repr)


@pytest.mark.parametrize("text", ["a%b", "al%et", "n__dle", "100\\%", "under\\_s", "a\\%b\\_c", "%", "alp%soup", "É%fé", "x%tail"])
def test_a_pattern_equals_the_scan(texts, text):
    df, index, columns = texts
    want = se.search_any(df, text, columns, wildcards=True)
    assert sorted(rows(index.search(text, wildcards=True)), key=repr) == sorted(rows(want), key=repr)


def test_pieces():
    assert _pieces("ab%c_d\\%e\\\\") == ["ab", "c", "d%e\\"] and _pieces("") == [""]


def test_only_files_with_candidates_are_read(spark, tmp_path):
    df = spark.range(64).coalesce(1).select("id", F.concat(F.lit("row "), F.col("id"), F.when(F.col("id") == 50, " special"))
                                            .alias("body"), F.lit("same").alias("note"))
    df = df.withColumn("body", F.coalesce("body", F.concat(F.lit("row "), F.col("id"))))
    index = TextIndex.build(df, str(tmp_path), ["body", "note"], rows_per_range=8)
    assert index.candidates(["spe", "cia"]).count() == 1
    for folder in glob.glob(f"{tmp_path}/rows/_range=*"):
        if not folder.endswith("=6"):
            _spoil(folder)
    assert [r["id"] for r in index.search("special").collect()] == [50]
