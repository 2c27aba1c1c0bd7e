import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row

from pageloom.operators.links import extract_links
from pageloom.plans.convert import pages_to_markdown
from pageloom.session import new_folder, shared_folder
from pageloom.sinks.documents import (
    document_files,
    export_layout,
    page_documents,
    write_document_table,
    write_documents,
)
from pageloom.sinks.markdown_folder import FolderWriter, MarkdownFolder, export_documents
from pageloom.sinks.report import report_lines, summary_lines, write_report, write_results
from pageloom.sources.pages import read_page_files, read_pages, stream_pages
from pageloom.streaming.flows import (
    append_stream,
    convert_stream,
    link_stream,
    markdown_stream,
    store_stream,
    visited_stream,
)

RESULTS = [
    ("https://h.example/", "# A & <b> ", 0, []),
    ("https://h.example/x?q=1", "one", 1, [0]),
    ("https://h.example/x?q=2", "two\n\"q\"", 1, [1]),
]


def results(spark, rows=RESULTS):
    return spark.createDataFrame(
        [(0, *r) for r in rows], "site int, url string, markdown string, depth int, path array<int>"
    )


def parts(folder):
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return "".join(open(os.path.join(folder, n), encoding="utf-8").read() for n in names)


def test_document_text(spark):
    row = page_documents(results(spark)).where("depth = 0").first()
    url = "https://h.example/"
    assert row.document == f"# {url}\n\n**Source URL:** {url}  \n**Depth:** 0  \n\n---\n\n# A & <b> \n"


def test_layout(spark):
    many, one = results(spark), results(spark, RESULTS[:1])
    assert tuple(export_layout(many, "out/s.MD").first()) == (3, "directory", "out/s")
    assert tuple(export_layout(one, "out/s.MD").first()) == (1, "file", "out/s.MD")
    assert tuple(export_layout(one, "out/s").first()) == (1, "directory", "out/s")


def test_documents_on_disk(spark, tmp_path):
    kept = document_files(results(spark), ["depth", "path"])
    assert {(r.file, r.markdown[:3]) for r in kept.collect()} == {("h_example_index.md", "# A"), ("h_example_x.md", "two")}
    target = write_documents(results(spark), str(tmp_path / "out.md"), ["depth", "path"])
    assert target == str(tmp_path / "out")
    assert sorted(n for n in os.listdir(target) if n.startswith("file=")) == ["file=h_example_index.md", "file=h_example_x.md"]
    assert parts(f"{target}/file=h_example_x.md").endswith('---\n\ntwo\n"q"\n')
    single = write_documents(results(spark, RESULTS[:1]), str(tmp_path / "one.md"), ["depth", "path"])
    assert parts(single).startswith("# https://h.example/\n")


def test_report_is_one_json_document(spark, tmp_path):
    lines = report_lines(results(spark).repartition(3), "https://h.example/?a=1&b")
    write_report(lines, str(tmp_path / "report"))
    text = parts(str(tmp_path / "report"))
    assert "\\u003cb\\u003e\\u2028" in text and "&" not in text
    got = json.loads(text)
    assert got["total"] == 3 and got["url"] == "https://h.example/?a=1&b"
    assert got["pages"] == [dict(url=u, markdown=m, depth=d) for u, m, d, _ in RESULTS]
    assert text.startswith('{\n  "pages": [\n    {\n      "url": "https://h.example/",\n')


def test_summary(spark):
    rows = summary_lines(results(spark)).orderBy("number").collect()
    assert [r.line for r in rows] == [
        "[1] https://h.example/ (depth: 0)",
        "[2] https://h.example/x?q=1 (depth: 1)",
        "[3] https://h.example/x?q=2 (depth: 1)",
    ]


def test_result_tables(spark, tmp_path):
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        write_results(results(spark), path, fmt)
        back = spark.read.format(fmt).load(path)
        assert {(r.url, r.markdown, r.depth) for r in back.collect()} == {r[:3] for r in RESULTS}


def test_page_files(spark, tmp_path):
    (tmp_path / "site" / "a").mkdir(parents=True)
    (tmp_path / "site" / "a" / "x.html").write_text("<p>hello\nworld")
    got = read_page_files(spark, str(tmp_path / "site"), "https://h.example/").collect()
    assert [(r.url, r.html) for r in got] == [("https://h.example/a/x.html", "<p>hello\nworld")]


def test_stream_equals_batch(spark, tmp_path):
    source = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "md")
    convert_stream(stream_pages(spark, str(tmp_path / "in"), files_per_batch=1), out, out + "-state").awaitTermination()
    streamed = spark.read.parquet(out).select("page_id", "url", "markdown")
    assert len(os.listdir(out)) == 3
    batch = pages_to_markdown(source)
    assert streamed.count() == 50 and streamed.exceptAll(batch).isEmpty()
    plain, held = str(tmp_path / "plain"), set(os.listdir(shared_folder(spark)))
    arriving = markdown_stream(stream_pages(spark, str(tmp_path / "in"), files_per_batch=1))
    append_stream(arriving, plain, plain + "-state").awaitTermination()
    assert spark.read.parquet(plain).exceptAll(batch).isEmpty() and spark.read.parquet(plain).count() == 50
    assert set(os.listdir(shared_folder(spark))) == held  # three batches leave only their output
    links = str(tmp_path / "links")
    append_stream(link_stream(stream_pages(spark, str(tmp_path / "in"))), links, links + "-state").awaitTermination()
    assert spark.read.parquet(links).exceptAll(extract_links(source)).isEmpty()


def test_visited_stream_forgets_after_a_day(spark, tmp_path):
    rows = [
        ("2024-01-01 00:00:00", "https://H.example/a/"),
        ("2024-01-01 05:00:00", "https://h.example/a#x"),
        ("2024-01-01 06:00:00", "bad"),
        ("2024-01-03 12:00:00", "https://h.example/b"),
        ("2024-01-04 00:00:00", "https://h.example/c"),  # its batch drops what has expired
        ("2024-01-04 12:00:00", "https://h.example/a"),
    ]
    for i, row in enumerate(rows):  # one file, one batch per row, in this order
        spark.createDataFrame([row], "ts string, url string").selectExpr(
            "cast(ts AS timestamp) AS ts", "url").coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    folders = str(tmp_path / "in*")
    stream = spark.readStream.schema("ts timestamp, url string").option("maxFilesPerTrigger", 1).json(folders)
    out = new_folder(spark, "visited")
    append_stream(visited_stream(stream), out, out + "-state").awaitTermination()
    got = sorted(r.url for r in spark.read.parquet(out).collect())
    assert got == ["https://h.example/a", "https://h.example/a", "https://h.example/b", "https://h.example/c"]


def test_store_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", "v")], "key string, value string").selectExpr(
        "key", "value", "timestamp'2024-01-01' AS written_at", "timestamp'2024-01-02' AS expires_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "store")
    store_stream(stream, out, out + "-state").awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_no_page_is_lost_to_its_name(spark, tmp_path):
    rows = [
        ("https://h.example/", "first", 0, []),
        ("http://[bad", "x", 1, [0]),
        (None, "y", 1, [1]),
        ("::", "z", 1, [2]),
        ("https://h.example/", "second capture", 1, [3]),
    ]
    got = {r.file: r.markdown for r in document_files(results(spark, rows), ["depth", "path"]).collect()}
    assert got == {"h_example_index.md": "second capture", "page_002.md": "x", "page_003.md": "y", "page_004.md": "z"}
    path = str(tmp_path / "table")
    write_document_table(results(spark, rows), path, ["depth", "path"], 2)
    back = {r.file: r.document for r in spark.read.parquet(path).collect()}
    assert set(back) == set(got) and back["h_example_index.md"].endswith("---\n\nsecond capture\n")


def test_export_is_one_file_a_page(spark, tmp_path):
    target = export_documents(results(spark).repartition(3), str(tmp_path / "out.md"), ["depth", "path"])
    assert target == str(tmp_path / "out")
    assert sorted(os.listdir(target)) == ["h_example_index.md", "h_example_x.md"]
    text = (tmp_path / "out" / "h_example_x.md").read_bytes().decode()
    assert text == page_documents(results(spark)).where("path = array(1)").first().document
    again = results(spark, [RESULTS[0][:1] + ("new",) + RESULTS[0][2:]])
    export_documents(again, target, ["depth", "path"])
    assert (tmp_path / "out" / "h_example_index.md").read_text().endswith("---\n\nnew\n")
    assert (tmp_path / "out" / "h_example_x.md").exists()
    single = export_documents(results(spark, RESULTS[:1]), str(tmp_path / "one.md"), ["depth", "path"])
    assert open(single, encoding="utf-8").read().startswith("# https://h.example/\n")
    assert sorted(os.listdir(tmp_path)) == ["one.md", "out"]


def test_failed_export_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('p', id, '.md') AS file", "if(id = 39, raise_error('stop'), 'text') AS document")
    target = tmp_path / "out"
    with pytest.raises(PySparkException):
        spark.dataSource.register(MarkdownFolder)
        rows.write.format("markdown_folder").mode("append").save(str(target))
    assert not target.exists() or os.listdir(target) == []


def test_commit_moves_only_what_successful_tasks_wrote(tmp_path):
    writer = FolderWriter(str(tmp_path / "out"))
    lost = writer.write(iter([Row(file="a.md", document="lost"), Row(file="b.md", document="lost")]))
    kept = writer.write(iter([Row(file="a.md", document="kept")]))
    assert lost.folder != kept.folder
    writer.commit([kept, None])
    assert os.listdir(tmp_path / "out") == ["a.md"] and (tmp_path / "out" / "a.md").read_text() == "kept"


def test_attempt_that_outlives_a_failed_export_writes_nothing(tmp_path):
    writer = FolderWriter(str(tmp_path / "out"))
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([Row(file="a.md", document="late")]))
    assert os.listdir(tmp_path / "out") == []


def test_export_makes_results_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    source = spark.range(30).selectExpr("id AS page_id", "concat('https://h.example/', id div 2) AS url", "'m' AS markdown", "0 AS depth")
    results = source.mapInArrow(counted, source.schema)
    export_documents(results, str(tmp_path / "out"), ["page_id"], "page_id")
    assert len(os.listdir(tmp_path / "out")) == 15
    assert made.value == 30
