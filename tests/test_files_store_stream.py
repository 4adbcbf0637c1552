import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import store
from textloom.sources.files import discovered, read_files
from textloom.streaming import events as stream
from textloom.streaming import ingest


def docx(*lines):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_file_readers(spark, tmp_path):
    files = {
        "a.txt": b"one\ntwo", "b.md": b"# Head\n\nSome **bold** [link](x).", "c.html": b"<html><title>T &amp; U</title><script>x</script><p>Body</p></html>", "d.json": b'{"b": 1, "a": [2]}', "e.xml": b"<r><x>hi</x> you</r>",
        "f.csv": b"x,y\n1,2\n3,4\n", "g.docx": docx("First", "", "Second"), "h.pdf": b"%PDF", "i.json": b"{broken", "j": b"plain",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    assert got["a.txt"].text == "one\ntwo" and json.loads(got["a.txt"].meta)["lines"] == 2
    assert got["b.md"].text == "Head\n\nSome bold link." and got["b.md"].title == "Head"
    assert got["c.html"].title == "T & U" and "x" not in got["c.html"].text.split()
    assert json.loads(got["d.json"].meta) == {"keys": ["a", "b"], "root": "dict"}
    assert got["e.xml"].text == "hi you" and json.loads(got["f.csv"].meta)["rows"] == 2
    assert got["g.docx"].text == "First\nSecond"
    assert got["h.pdf"].text is None and "no reader" in got["h.pdf"].error and "JSONDecodeError" in got["i.json"].error
    assert got["j"].kind == "txt"


def test_discovery(spark, tmp_path):
    for name in ("src/a.py", "src/b.h", "vendor/c.py", "notes.bin", "z.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [(r.path.rsplit("/", 1)[1], r.language) for r in discovered(spark, str(tmp_path)).collect()] == [("a.py", "python"), ("b.h", "cpp"), ("z.go", "go")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "chunk_id string, document_id string, user_id string, model_id string, vector array<double>"
    rows = [("a1", "a", "u", "m", [1.0]), ("a2", "a", "u", "m", [2.0]), ("b1", "b", "u", "m", [3.0]), ("c1", "c", None, "m", [4.0]), ("d1", "d", "u", "m", None)]
    store.add(spark.createDataFrame(rows, schema), path)
    assert store.read(spark, path).count() == 4 and store.read(spark, path, "default").count() == 1
    gone = spark.createDataFrame([("u", "m", "a"), (None, "m", "c"), ("u", "m", "zzz")], "user_id string, model_id string, document_id string")
    assert store.delete_documents(spark, path, gone) == 3
    assert [r.chunk_id for r in store.read(spark, path).collect()] == ["b1"]
    assert store.delete_documents(spark, path, gone) == 0
    assert store.stats(store.read(spark, path)).first().chunks == 1
    with pytest.raises(ValueError):
        store.drop_store(spark, path)
    store.drop_store(spark, path, confirm=True)
    assert not (tmp_path / "store").exists()


def test_store_keys_with_signs_numbers_and_empty_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "chunk_id string, document_id string, user_id string, model_id string, vector array<float>"
    users = ["a/b:c", "a b%", "007", "", "2024-01-01", "ü=x"]
    store.add(spark.createDataFrame([(f"k{i}", "d", u, "m", [1.0]) for i, u in enumerate(users)], schema), path)
    wanted = sorted(u or "default" for u in users)
    assert sorted(r.user_id for r in store.read(spark, path).collect()) == wanted
    for left, user in enumerate(wanted, 1):
        gone = spark.createDataFrame([(user, "m", "d")], "user_id string, model_id string, document_id string")
        if left < len(wanted):
            assert store.delete_documents(spark, path, gone) == 1
            assert sorted(r.user_id for r in store.read(spark, path).collect()) == wanted[left:]
    assert {p.parents[1].name for p in (tmp_path / "store").rglob("*.parquet")} == {"user_id=ü%3Dx"}


def test_records_of_code(spark):
    element = "element_id int, type string, name string, content string, start_line int, end_line int, file_path string, language string, complexity int, docstring string, parameters array<string>, return_type string"
    file = "file_path string, language string, line_count int, complexity_score double, documentation string, imports array<string>"
    files = spark.createDataFrame([("r/a.py", "python", 9, 2.0, "Doc", ["x", "y", None]), ("r/b.py", "python", 5, None, None, None), ("r/c.go", "go", None, 1.0, None, []), ("q/z", None, None, None, None, None)], file)
    elements = spark.createDataFrame([(1, "Function", "Do it", "code", 1, 2, "r/a.py", None, 3, " ", ["a"], None), (2, "class", "B", None, 1, 1, "r/none.py", "go", None, "Says.", None, "int")], element)
    got = {r.element_id: r for r in store.element_records(elements, files).collect()}
    assert got[1].name == "r_a.py_do_it_function" and "No documentation." in got[1].markdown and got[1].markdown.endswith("Its file has 9 lines and 3 imports.")
    assert got[2].code_md5 is None and "Says." in got[2].markdown and "Returns: int" in got[2].markdown and "Its file" not in got[2].markdown
    records = {r.repo: r.markdown for r in store.repository_records(files).collect()}
    assert records["r"] == "# r\n\nFiles: 3, lines: 14, documented: 33 %\n\n## python (2 files)\n- r/a.py\n- r/b.py\n\n## go (1 files)\n- r/c.go\n\nPackages: x, y"
    assert records["q"] == "# q\n\nFiles: 1, lines: 0, documented: 0 %"


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("A Title: x!", "Body", "http://x", None)], "title string, content string, url string, date timestamp")
    record = store.knowledge_records(rows).first()
    assert record.name == "a-title-x" and record.markdown == "# A Title: x!\n\nBody\n\nSource: http://x"
    store.export_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def _drain(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}")


def test_windows_of_a_stream_match_the_batch(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    source = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)
    q = stream.windowed(source()).writeStream.outputMode("complete").format("memory").queryName("win").start()
    got = {(r.start, r.event_type): r.events for r in _drain(q, spark, "win").collect()}
    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type").count()
    assert got == {(r.h, r.event_type): r["count"] for r in batch.collect()}
    q = stream.once(source().union(source())).writeStream.format("memory").queryName("uniq").start()
    assert _drain(q, spark, "uniq").count() == spark.read.parquet(f"{data}/events.parquet").count()
    q = stream.sessions(source()).writeStream.outputMode("complete").format("memory").queryName("sess").start()
    assert _drain(q, spark, "sess").agg(F.sum("events")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_ingest_takes_each_file_once(spark, tmp_path):
    inbox, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    inbox.mkdir()
    (inbox / "a.txt").write_text("The planner reads the open requests and keeps the answers of the week in the store for all users.")
    for _ in range(2):
        ingest.ingest(ingest.document_stream(spark, str(inbox)), str(out), str(mark)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 1


def test_history_state(spark, tmp_path):
    folder = tmp_path / "turns"
    rows = [(1, t, f"text {t // 2}") for t in range(60)] + [(2, 0, None), (2, 1, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(folder))
    turns = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(folder))
    q = ingest.history(turns).writeStream.outputMode("update").format("memory").queryName("hist").start()
    assert {tuple(r) for r in _drain(q, spark, "hist").collect()} == {(1, 20, "text 29"), (2, 1, "x")}
