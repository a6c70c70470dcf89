import duckdb

from lacuna.llm import license_scan, queries


def _keys(rows):
    return sorted(map(str, rows))


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.SQL["op1_license_scan"])
    got = queries.op1_license_scan(spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert _keys(got.select(*want.columns).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)) == _keys(
        want.df().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)
    )


def test_nearest_license_above_and_no_python(spark):
    files = spark.createDataFrame(
        [
            ("/a", "LICENSE", "Released under the MIT License."), ("/a/b", "LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0."), ("/a/b/c", "one", "no notice"),
            ("/a/d", "two", None), ("/a/d", "two", None), ("/a/b/c", "own", "code\nAll rights reserved.\ncode"), ("/ab", "three", ""), (None, None, "text"), ("/a/b", "LICENSE2", "licensed to nobody at all here"),
        ],
        "directory string, name string, text string",
    ).withColumn("score", files_score())
    found = license_scan.scan(files)
    got = {(r.directory, r.name): (r.license, r.origin, r.from_directory) for r in found.collect()}
    assert got["/a/b/c", "one"] == ("Apache-2.0", "directory", "/a/b")
    assert got["/a/d", "two"] == ("MIT", "directory", "/a")
    assert got["/a/b/c", "own"] == ("proprietary", "file", None)
    assert got["/ab", "three"] == (None, "none", None) and got["", ""] == (None, "none", None)
    assert found.count() == 9
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def files_score():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_odd_and_empty(odd, none):
    assert license_scan.scan_documents(odd).count() == odd.count()
    assert license_scan.scan_documents(none).count() == 0
