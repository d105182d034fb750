import pytest

from sightline.sources import csv, results


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(
        'Id,id,name,score,flag,x\n1,2,"a,b",1.5,True,NA\n3,4,none,,False,None\n'
        '5,6,"q""uote",2,TRUE,\n1,2,3\n1,2,3,4,5,6,7\n7,8,long,9,true,1,\n9,10,z,abc,no, 7 \n'
    )
    (tmp_path / "b.csv").write_bytes("id,town\n1,café\n2,München\n".encode("latin1"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "same.csv").write_text("a,a,b\n1,2,3\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.csv").write_text("a\n1\n")
    return str(tmp_path)


def test_missing_tokens_long_and_short_lines(spark, folder):
    df = csv.read_csv_text(spark, f"{folder}/a.csv").toDF(*"abcdef")
    got = [tuple(r) for r in df.collect()]
    assert got == [
        ("1", "2", "a,b", "1.5", "True", None), ("3", "4", "none", None, "False", None),
        ("5", "6", 'q"uote', "2", "TRUE", None), ("1", "2", "3", None, None, None),
        ("9", "10", "z", "abc", "no", " 7 "),
    ]
    # The rows do not depend on the columns a query uses.
    assert df.count() == 5 and len(df.select("b").collect()) == 5


def test_types_and_encoding(spark, folder):
    assert [t for _, t in csv.read_csv(spark, f"{folder}/a.csv").dtypes] == [
        "bigint", "bigint", "string", "string", "string", "bigint"
    ]
    towns = csv.read_csv(spark, f"{folder}/b.csv")
    assert [r["town"] for r in towns.orderBy("id").collect()] == ["café", "München"]


def test_folder_skips_what_cannot_be_read(spark, folder):
    assert set(csv.read_folder(spark, folder, "strict")) == {"a.csv", "b.csv", "same.csv"}
    status = {r["path"].rsplit("/", 1)[-1]: r for r in csv.read_folder_status(spark, folder)[1].collect()}
    assert {n for n, r in status.items() if r["status"] == "read"} == {"a.csv", "b.csv", "same.csv"}
    assert all(r["reason"] for r in status.values() if r["status"] == "failed")
    assert csv.read_csv(spark, f"{folder}/same.csv").columns == ["a", "a.1", "b"]


def test_required_columns(spark, folder):
    df = csv.read_required(spark, [f"{folder}/none.csv", f"{folder}/a.csv"], ["ID", "score", "zzz"])
    assert df.columns == ["id", "score"]
    assert [r["id"] for r in df.collect()][:2] == [1, 3]
    with pytest.raises(ValueError):
        csv.read_required(spark, [f"{folder}/a.csv"], ["nothing"])
    with pytest.raises(FileNotFoundError):
        csv.read_required(spark, [f"{folder}/none.csv"], ["a"])


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["  Zip Code ", "B-c"])
    assert csv.normalize_header(df, "light").columns == ["zip code", "b-c"]
    assert csv.normalize_header(df, "underscore").columns == ["zip_code", "b-c"]
    assert csv.normalize_header(df, "strict").columns == ["zip_code", "b_c"]


def test_missing_json_is_empty(spark, tmp_path):
    assert results.load_json(spark, str(tmp_path / "none.json"), "a int").collect() == []
    results.save_json(spark.range(3), str(tmp_path / "r.json"))
    assert results.load_json(spark, str(tmp_path / "r.json"), "id long").count() == 3


def test_lawful_replacement_characters_are_no_foreign_encoding(spark, tmp_path):
    (tmp_path / "marks.csv").write_text("id,town\n1,café\n2,a�b\n", encoding="utf-8")
    got = csv.read_csv(spark, f"{tmp_path}/marks.csv").collect()
    assert [r["town"] for r in got] == ["café", "a�b"]


def test_files_read_together_equal_files_read_alone(spark, folder, tmp_path):
    (tmp_path / "only header.csv").write_text("p,q+r\n")
    (tmp_path / "blank.csv").write_text("\n\nk,v\n1,2\n")
    together = csv.read_files(spark, folder)
    names = {p.rsplit("/", 1)[-1] for p in together}
    assert names == {"a.csv", "b.csv", "same.csv", "only header.csv", "blank.csv"}
    for path, frame in together.items():
        alone = csv.read_csv(spark, path)
        assert frame.dtypes == alone.dtypes
        assert sorted(map(str, frame.collect())) == sorted(map(str, alone.collect()))


def test_parts_of_a_csv_folder_are_one_table(spark, tmp_path):
    results.save_csv(spark.range(40).selectExpr("id", "concat('n', id) AS name").repartition(3), f"{tmp_path}/t.csv")
    ((path, frame),) = csv.read_files(spark, str(tmp_path)).items()
    assert path.endswith("/t.csv") and frame.dtypes == [("id", "bigint"), ("name", "string")]
    assert sorted(r["id"] for r in frame.collect()) == list(range(40))


def test_staged_files_are_typed_parquet(spark, folder):
    plain, staged = csv.read_folder(spark, folder, "strict"), csv.read_folder(spark, folder, "strict", stage=True)
    town = staged["b.csv"]
    assert town.dtypes == plain["b.csv"].dtypes and sorted(town.collect()) == sorted(plain["b.csv"].collect())
    assert all(f.endswith(".parquet") for f in town.inputFiles())


def test_the_number_of_jobs_does_not_depend_on_the_number_of_files(spark, tmp_path):
    def jobs(n):
        place = tmp_path / f"of{n}"
        place.mkdir()
        for i in range(n):
            (place / f"f{i}.csv").write_text("id,name\n" + "".join(f"{j},x{j}\n" for j in range(i % 5)))
        context = spark.sparkContext
        context.setJobGroup(f"files{n}", "")
        try:
            found = csv.read_files(spark, str(place))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        assert len(found) == n
        return len(context.statusTracker().getJobIdsForGroup(f"files{n}"))

    assert jobs(3) == jobs(24)
