import json

from pyspark.sql import functions as F

from foliate.operators import packing
from foliate.functions import text as tx
from foliate.sources.documents import page_table, read_chunks, read_documents, read_first, read_items, write_chunks, write_results
from foliate.streaming.documents import document_stream, event_counts, sessions, typed


def folder(tmp_path):
    docs = {
        "a": {"id": "1", "text": "One. Two.\nÉtat.", "source": "s", "metadata": {"Source-File": "f", "pdf-total-pages": 2}, "attributes": {"pdf_page_numbers": [[0, 10, 1], [10, 15, 2]]}},
        "b": {"text": "x" * 3000},
        "c": [{"text": "p"}, {"text": "q"}],
    }
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, ensure_ascii=False))
    return str(tmp_path)


def test_documents_pages_and_sizes(spark, tmp_path):
    path = folder(tmp_path)
    got = {r["doc_id"]: r for r in read_documents(spark, f"{path}/[ab].json").collect()}
    assert got["a"]["text"] == "One. Two.\nÉtat." and got["a"]["n_pages"] == 2 and got["b"]["id"] == "unknown" and got["b"]["pages"] == []
    assert sorted(map(tuple, page_table(read_documents(spark, f"{path}/a.json")).collect())) == [("a", 0, 10, 1), ("a", 10, 15, 2)]
    assert [r["doc_id"] for r in read_documents(spark, f"{path}/[ab].json", least_bytes=1000).collect()] == ["b"]
    assert {r["doc_id"]: r["text"] for r in read_items(spark, path).collect()}["c"] == "p\n\nq"


def test_chunks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One. Two. Three."), ("b", "Four.")], "doc_id string, text string")
    chunks = packing.pack(docs, tx.sentences(F.col("text")), packing.before_limit(10, 1), " ").withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")).withColumn("level", F.lit(1))
    out = str(tmp_path / "chunks")
    write_chunks(chunks, out)
    assert {r["id"]: r["text"] for r in read_chunks(spark, out).collect()} == {"a-0": "One. Two.", "a-1": "Three.", "b-0": "Four."}


def test_streams(spark, tmp_path, sf):
    path = tmp_path / "in"
    path.mkdir()
    folder(path)
    (path / "c.json").unlink()
    typed(document_stream(spark, str(path))).writeStream.format("memory").queryName("typed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r["doc_id"] for r in spark.table("typed").collect()} == {"a", "b"}
    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    assert event_counts(events).agg(F.sum("events")).first()[0] == n and sessions(events).agg(F.sum("events")).first()[0] == n


def test_first_folder_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder(tmp_path / "in")
    found = read_first(spark, [str(tmp_path / "none"), str(tmp_path / "in")], 1)
    assert [r["doc_id"] for r in found.collect()] == ["a"] and read_first(spark, [str(tmp_path / "none")]) is None
    assert {r["doc_id"] for r in read_first(spark, [str(tmp_path)], 2, below=True).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("é", None, [0.5, 1.0])], "name string, n long, v array<double>")
    write_results(rows, str(tmp_path / "out"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "out")).collect() == rows.collect()
    assert "é" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))
