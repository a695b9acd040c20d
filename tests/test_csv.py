"""CSV in and out."""

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from dayweave.operators.panels import with_day
from dayweave.sources import read_scored_csv, read_wide_csv, write_scored_csv, write_sorted, write_wide_csv
from dayweave.spec import SCORED_POSTS

HEADER = "id,Authenticity,text,CountryElection,user_name,type_of_account,created_at_seconds,Analytic\n"
LINES = [
    '1,18.5,"one\nline ""quoted"", two",El Salvador 2014,Salvador Sánchez Cerén,candidato,2013-09-23 03:15:00,71.25\n',
    "2,NA,plain,El Salvador 2014,NA,candidato,2013-09-23 23:59:59,\n",
    "3,NaN,,El Salvador 2014,,partido,NA, 5\n",
    '4,"7",NA,"Honduras 2013","Orle Solís",partido,bad,abc\n',
]


@pytest.fixture
def read(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(HEADER + "".join(LINES), encoding="utf-8")
    df = read_scored_csv(spark, str(path), SCORED_POSTS, extra=["id", "text"])
    return {r.id: r for r in with_day(df, SCORED_POSTS).collect()}


def test_columns_are_found_by_name(read):
    r = read["1"]
    assert (r.CountryElection, r.type_of_account) == ("El Salvador 2014", "candidato")
    assert (r.user_name, r.Analytic, r.Authenticity) == ("Salvador Sánchez Cerén", 71.25, 18.5)
    assert r.created_at_seconds2 == date(2013, 9, 23)


def test_quotes_and_line_breaks(read):
    assert len(read) == 4
    assert read["1"].text == 'one\nline "quoted", two'


def test_missing_values(read):
    assert (read["2"].Authenticity, read["2"].Analytic, read["2"].user_name) == (None, None, None)
    assert read["2"].created_at_seconds2 == date(2013, 9, 23)
    assert str(read["3"].Authenticity) == "nan"
    assert (read["3"].user_name, read["3"].text, read["3"].Analytic) == ("", "", 5.0)
    assert read["3"].created_at_seconds is None
    assert (read["4"].text, read["4"].Analytic, read["4"].created_at_seconds2) == (None, None, None)
    assert (read["4"].Authenticity, read["4"].CountryElection) == (7.0, "Honduras 2013")


@pytest.mark.parametrize("quoted_newlines", [True, False])
def test_files_must_agree_on_the_header(spark, tmp_path, quoted_newlines):
    (tmp_path / "a.csv").write_text(HEADER + LINES[1], encoding="utf-8")
    df = read_scored_csv(spark, str(tmp_path), SCORED_POSTS, quoted_newlines=quoted_newlines)
    assert df.count() == 1
    assert df.columns == [
        "CountryElection", "type_of_account", "user_name", "Authenticity", "Analytic", "created_at_seconds",
    ]
    swapped = HEADER.replace("Authenticity", "x").replace("Analytic", "Authenticity").replace("x,", "Analytic,", 1)
    (tmp_path / "b.csv").write_text(swapped + LINES[1], encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        read_scored_csv(spark, str(tmp_path), SCORED_POSTS, quoted_newlines=quoted_newlines).collect()


def test_awkward_texts_round_trip(spark, tmp_path):
    texts = ['a,b', '"', '""', "line\nbreak", "cr\r\nlf", " padded ", "", "tab\t", "back\\slash", "\\", "ñ–"]
    df = spark.createDataFrame(
        [(t, "candidato", f"u{i}", float(i), None, "2020-01-01 00:00:00") for i, t in enumerate(texts)],
        "CountryElection string, type_of_account string, user_name string, Authenticity double, "
        "Analytic double, created_at_seconds string",
    )
    write_scored_csv(df, str(tmp_path / "out"))
    back = read_scored_csv(spark, str(tmp_path / "out"), SCORED_POSTS)
    assert sorted(r[0] for r in back.collect()) == sorted(texts)
    assert back.where(F.col("Analytic").isNull()).count() == len(texts)


def test_wide_file_layout(spark, tmp_path):
    values = [(0, 1.0, 0.5), (1, 1 / 3, 0.0), (2, 100.0, None)]
    rows = [("f_Spon", 2, "HO21_MiltonBenítez_Spon", t, v) for t, _, v in values]
    rows += [("f_Spon", 1, "HO21_Z_Spon", t, v) for t, v, _ in values]
    rows += [("f_An", 1, 'HO21_"q"_An', 0, 2.0)]
    df = spark.createDataFrame(rows, "name string, position int, column string, t int, value double")
    write_wide_csv(df, str(tmp_path / "wide"))
    (part,) = glob.glob(str(tmp_path / "wide" / "name=f_Spon" / "part-*"))
    with open(part, encoding="utf-8") as f:
        assert f.read() == (
            '"","HO21_Z_Spon","HO21_MiltonBenítez_Spon"\n'
            '"1",1,0.5\n"2",0.333333333333333,0\n"3",100,NA\n'
        )
    back = read_wide_csv(spark, os.path.dirname(part))
    assert back.columns == ["row", "HO21_Z_Spon", "HO21_MiltonBenítez_Spon"]
    assert [tuple(r) for r in back.orderBy("row").collect()][2] == (3, 100.0, None)
    (part,) = glob.glob(str(tmp_path / "wide" / "name=f_An" / "part-*"))
    with open(part, encoding="utf-8") as f:
        assert f.readline() == '"","HO21_""q""_An"\n'


def test_series_of_unequal_length(spark, tmp_path):
    rows = [("f", 1, "A", t, 100.0 + t) for t in (0, 1)] + [("f", 2, "B", t, 200.0 + t) for t in (0, 1, 2)]
    rows += [("g", 1, "A", 1, 1.0), ("g", 3, "C", 0, 3.0)]
    df = spark.createDataFrame(rows, "name string, position int, column string, t int, value double")
    write_wide_csv(df.repartition(3), str(tmp_path / "wide"))
    texts = {}
    for name in "fg":
        (part,) = glob.glob(str(tmp_path / "wide" / f"name={name}" / "part-*"))
        with open(part, encoding="utf-8") as f:
            texts[name] = f.read()
    assert texts["f"] == '"","A","B"\n"1",100,200\n"2",101,201\n"3",NA,202\n'
    assert texts["g"] == '"","A","C"\n"1",NA,3\n"2",1,NA\n'
    back = read_wide_csv(spark, str(tmp_path / "wide" / "name=f"))
    assert [tuple(r) for r in back.orderBy("row").collect()][2] == (3, None, 202.0)


def test_sorted_tables_have_few_files_in_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).alias("p"), (F.col("id") * 7919 % 5000).alias("x")).repartition(16)
    write_sorted(df, str(tmp_path / "t"), "p", ["x"])
    for p in range(3):
        files = sorted(glob.glob(str(tmp_path / "t" / f"p={p}" / "part-*.parquet")))
        assert len(files) <= 8
        values = [r.x for f in files for r in spark.read.parquet(f).collect()]
        assert values == sorted(values) and len(values) in (1666, 1667)
    assert len(glob.glob(str(tmp_path / "t" / "*" / "part-*"))) <= 8 + 2
