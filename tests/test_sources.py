"""Readers, sinks and streams, on files written here."""

import zipfile

from pyspark.sql import functions as F

from glossaloom.config import RuleSet
from glossaloom.sources import readers, sinks
from glossaloom.streaming.labels import label_stream, to_parquet


def test_csv_and_headers(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f'id,text,x\n1,"one, ""two""\nthree {name}",9\n')
    rows = readers.read_csv(spark, f"{tmp_path}/*.csv", ["id", "text"], parent=True).orderBy("parent").collect()
    assert [(r.parent, r.id, r.text) for r in rows] == [("a", "1", 'one, "two"\nthree a'), ("b", "1", 'one, "two"\nthree b')]
    assert readers.header(spark, f"{tmp_path}/a.csv") == ["id", "text", "x"]
    assert readers.list_files(spark, str(tmp_path), "*.csv").count() == 2


def test_xml_and_zip(spark, tmp_path):
    xml = "<root><rec><id>1</id><text>hello</text></rec><rec><id>2</id><text>bye</text></rec></root>"
    (tmp_path / "f.xml").write_text(xml)
    assert [(r.id, r.text) for r in readers.read_xml(spark, f"{tmp_path}/f.xml", ["id", "text"], "rec").orderBy("id").collect()] == [("1", "hello"), ("2", "bye")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("one.csv", "id,text\n1,a\n")
        z.writestr("two.csv", "id,text\n2,b\n")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.xml", xml)
    assert sorted((r.parent, r.id, r.text) for r in readers.read_zip(spark, f"{tmp_path}/c.zip", ["id", "text"], parent=True).collect()) == [("c", "1", "a"), ("c", "2", "b")]
    assert sorted((r.id, r.text) for r in readers.read_zip(spark, f"{tmp_path}/x.zip", ["id", "text"], kind="xml", row_tag="rec").collect()) == [("1", "hello"), ("2", "bye")]
    assert readers.header(spark, f"{tmp_path}/c.zip", kind="zip") == ["id", "text"]


def test_file_texts(spark, tmp_path):
    for name, text in (("a.txt", "first\nfile"), ("b.txt", "second")):
        (tmp_path / name).write_text(text)
    rows = spark.createDataFrame([(1, "b.txt;;a.txt"), (2, "none.txt"), (3, "a.txt; ;none.txt")], "id long, filename string")
    found = readers.join_file_texts(rows, readers.file_texts(spark, str(tmp_path))).collect()
    assert {r.id: r.text for r in found} == {1: "second first\nfile"}


def test_file_texts_below_folders(spark, tmp_path):
    for name, text in (("a/x.txt", "one"), ("b/x.txt", "two"), ("x.txt", "top"), ("b/my file+1%.txt", "odd")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    texts = readers.file_texts(spark, f"{tmp_path}/")
    assert {r.name for r in texts.collect()} == {"a/x.txt", "b/x.txt", "x.txt", "b/my file+1%.txt"}
    rows = spark.createDataFrame([(1, "a/x.txt", "b"), (1, "x.txt;;x.txt", "a"), (2, "x.txt", "b"), (2, "x.txt", "b"), (3, "", "a"), (4, None, None), (5, "x.txt", None)], "id long, filename string, dir string").repartition(3)
    told = lambda found: sorted((r.id, r.text) for r in found.collect())
    assert told(readers.join_file_texts(rows, texts)) == [(1, "one"), (1, "top top"), (2, "top"), (2, "top"), (5, "top")]
    assert told(readers.join_file_texts(rows, texts, parent="dir")) == [(1, "one one"), (2, "two"), (2, "two"), (5, "top")]
    assert told(readers.join_file_texts(rows, texts, folder="b")) == [(1, "two two"), (2, "two"), (2, "two"), (5, "two")]
    assert readers.join_file_texts(rows, texts).columns == ["id", "dir", "text"]


def test_metadata_and_documents(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("Key,Größe\nx,5\n".encode("latin-1"))
    row = readers.read_metadata(spark, f"{tmp_path}/m.csv", ["Key", "Größe"], "Key").first()
    assert row.asDict() == {"id": "x", "größe": 5}
    (tmp_path / "d.bin").write_bytes(b"content")
    assert readers.read_documents(spark, f"{tmp_path}/d.bin", lambda b: b.decode().upper()).first().text == "CONTENT"
    assert readers.read_documents(spark, f"{tmp_path}/d.bin", lambda b: None).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", ["a b", "c"])], "id long, src string, chunks array<string>")
    sinks.write_extracts(rows, f"{tmp_path}/p", by=["src"])
    assert spark.read.parquet(f"{tmp_path}/p").first().chunks == ["a b", "c"]
    sinks.write_extracts(rows, f"{tmp_path}/c", kind="csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first().text == "a b|c"
    sinks.write_csv(rows.drop("chunks"), f"{tmp_path}/v", first=["src"])
    assert spark.read.csv(f"{tmp_path}/v", header=True).columns == ["src", "id"]
    sinks.write_texts(spark.createDataFrame([("a b", "text")], "name string, text string"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").first().name == "a_b"


def test_table(spark):
    rows = spark.createDataFrame([(1, "x", 2.5, 1)], "id long, name string, size double, t int")
    sinks.create_table(rows, "glossaloom_test", {"id": "INTEGER", "name": "TEXT", "size": "REAL"}, ["t"])
    try:
        sinks.append_table(rows.withColumn("id", F.lit(2).cast("long")), "glossaloom_test")
        assert sinks.table_exists(rows, "glossaloom_test")
        assert sorted(r.id for r in readers.read_table(spark, "glossaloom_test").collect()) == [1, 2]
    finally:
        spark.sql("DROP TABLE glossaloom_test")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "one hour"), (2, "none")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    query = to_parquet(label_stream(stream, ["hour"], [RuleSet.of([("hour", 0, 1)], ["t"])]), f"{tmp_path}/out", f"{tmp_path}/at")
    query.awaitTermination(60)
    assert [(r.id, r.t) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 1)]


def test_extract_files(spark, tmp_path):
    spark.createDataFrame([(1, "a", "t")], "id int, text string, tag string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(2, "b")], "id int, text string").toPandas().to_csv(tmp_path / "x.csv", index=False)
    spark.createDataFrame([(3, "c")], "id int, text string").write.parquet(f"{tmp_path}/x_full")
    paths = [f"{tmp_path}/p", f"{tmp_path}/x.csv", f"{tmp_path}/x_full"]
    assert sorted((str(r.id), r.text, r.tag) for r in readers.read_extracts(spark, paths).collect()) == [("1", "a", "t"), ("2", "b", None), ("3", "c", None)]
    found = readers.read_extracts(spark, paths, ["id", "text"], full=False)
    assert found.columns == ["id", "text"] and {str(r.id) for r in found.collect()} == {"1", "2"}


def test_header_of_zipped_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("x.xml", "<?xml version='1.0'?><root><rec><id>1</id><text>a</text></rec><rec><other/></rec></root>")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as archive:
        archive.writestr("c.csv", "id,text\n1,a\n")
    assert readers.header(spark, f"{tmp_path}/x.zip", kind="zip", row_tag="rec") == ["id", "text"] == readers.header(spark, f"{tmp_path}/x.zip", kind="zip")
    assert readers.header(spark, f"{tmp_path}/c.zip", kind="zip") == ["id", "text"]
