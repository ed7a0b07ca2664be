"""Tables of many small documents: files don't grow with the number of documents, and what is read is what was saved."""

from pyspark.sql import functions as F

from quire.sources import readers, writers


def test_blocks_of_many_jobs_are_few_files(spark, tmp_path):
    path = str(tmp_path / "blocks")
    rows = spark.range(0, 3000, 1, 2).select((F.col("id") % 1000).cast("string").alias("job_id"), F.floor(F.col("id") / 1000).cast("int").alias("pos"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("id"), F.lit("x\ny").alias("source"))
    writers.save_documents(rows, path)
    assert len(list((tmp_path / "blocks").rglob("part-*"))) <= 2 * writers.BUCKETS
    back = readers.read_documents(spark, path, lines=True)
    assert back.count() == 3000 and back.select("job_id").distinct().count() == 1000 and back.columns == ["pos", "id", "type", "source", "translation", "status", "error", "job_id"]
    one = readers.read_document(spark, path, "7", lines=True)
    assert sorted((r.pos, r.id, r.source) for r in one.collect()) == [(0, "b7", "x\ny"), (1, "b1007", "x\ny"), (2, "b2007", "x\ny")]
    assert readers.read_document(spark, path, "none", lines=True).count() == 0
    writers.put_json(rows.where("job_id = '5'"), str(tmp_path / "old"), ("job_id",))  # a folder a job is still read
    assert readers.read_document(spark, str(tmp_path / "old"), "5", lines=True).count() == 3


def test_markdown_of_many_documents_is_few_files(spark, tmp_path):
    path = str(tmp_path / "markdown")
    save = lambda rows: writers.save_markdown(spark.createDataFrame(rows, "doc_id bigint, markdown string"), path)
    save([(i, f"# {i}\n\r\nx") for i in range(500)] + [(7, "again"), (None, "no id"), (501, None)])
    files = len(list((tmp_path / "markdown").rglob("*.parquet")))
    assert files <= 8
    first = {(r.doc_id, r.value) for r in readers.read_markdown(spark, path).collect()}
    assert len(first) == 503 and {("7", "# 7\n\r\nx\n"), ("7", "again\n"), (None, "no id\n"), ("501", None)} <= first
    save([(7, "new"), (None, "new"), (600, "")])  # these are replaced, the others stay
    second = {(r.doc_id, r.value) for r in readers.read_markdown(spark, path).collect()}
    assert second == {x for x in first if x[0] not in ("7", None)} | {("7", "new\n"), (None, "new\n"), ("600", "\n")}


def test_html_is_a_file_a_name_in_one_folder(spark, tmp_path):
    names = ["a b.html", "50%/x.html", "._h", "（双语）+&.html", "%41", "c#d?.html"]
    save = lambda rows: writers.save_html(spark.createDataFrame(rows, "name string, html string"), str(tmp_path / "html"))
    save([(n, f"<p>\n{n}") for n in names] + [(None, "x")])
    save([(names[1], "new")])
    assert {(r.name, r.value) for r in readers.read_html(spark, str(tmp_path / "html")).collect()} == {(n, "new\n" if n == names[1] else f"<p>\n{n}\n") for n in names} | {(None, "x\n")}
    assert not any(f.is_dir() for f in (tmp_path / "html").iterdir()) and len([f for f in (tmp_path / "html").iterdir() if f.name[0] != "."]) == len(names) + 1
