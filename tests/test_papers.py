"""Processing of archives, feeds, tables of vectors, batches, splits and reports."""

from __future__ import annotations

import http.server
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import corpus, dense, papers, pooling, vocab
from palimpsest.sources import shared
from palimpsest.sources.feed import FeedSource
from palimpsest.sources.papers import append_new, parse_feed, read_chunks, write_chunks

MAIN = r"\begin{document}\maketitle \section{One} %s \section{References} z \end{document}"


def test_process_sources(spark, tmp_path):
    """Visits, skips, is not repeated, is capped, and is replaced on demand."""
    bad = "a & " * 9
    archives = spark.createDataFrame([("a", {"main.tex": MAIN % "good text"}), ("b", {"main.tex": MAIN % bad}), ("c", {"x.sty": "no main"}), ("d", {"main.tex": MAIN % "more"})], "doc_id string, files map<string, string>")
    metadata = spark.createDataFrame([(i, f"T {i}", (f"20{n}-01-01", None)) for i, n in (("a", 20), ("b", 21), ("c", 21), ("d", 22))], "doc_id string, title string, dates struct<submitted: string, updated: string>")
    path = f"{tmp_path}/out"
    first = papers.process_sources(archives, metadata, path, max_papers=3).first()
    assert (first.visited, first.successful, first.skipped, first.skipped_percent) == (3, 2, 1, 33.33)
    assert [(r.doc_id, r.year) for r in spark.read.parquet(f"{path}/processed").collect()] == [("a", 2020)]
    papers.process_sources(archives, metadata, path)
    done = spark.read.parquet(f"{path}/processed")
    assert sorted(r.doc_id for r in done.collect()) == ["a", "d"] and done.filter("doc_id = 'a'").first().sections[0].text == "good text"
    assert [r.doc_id for r in papers.latest_skipped(spark, path).collect()] == ["b"]
    papers.process_sources(archives, metadata, path, overwrite=True)
    assert spark.read.parquet(f"{path}/processed").count() == 2 and spark.read.parquet(f"{path}/skipped").count() == 1


def test_feed_source(spark):
    """Pages are asked for until one is empty; a request that fails is repeated."""
    asked: list[tuple[int, str]] = []

    class Feed(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            asked.append((int(query["start"][0]), query["search_query"][0]))
            entry = '<entry><id>http://x/abs/2101.0000{}v2</id><title>T</title><summary>S</summary><category term="hep"/></entry>'
            self.send_response(500 if len(asked) == 2 else 200)
            self.end_headers()
            self.wfile.write(f"<feed>{entry.format(asked[-1][0] // 100) if asked[-1][0] < 200 else ''}</feed>".encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(FeedSource)
    pages = spark.read.format("paper_feed").options(url=f"http://127.0.0.1:{server.server_port}/", category="hep", start="2021-01-01", end="2021-01-02", delay="0").load()
    assert sorted(r.arxiv_id for r in parse_feed(pages, "hep").collect()) == ["2101.00000", "2101.00001"]
    server.shutdown()
    assert [a for a, _ in asked] == [0, 100, 100, 200] and asked[0][1] == "cat:hep AND submittedDate:[202101010000 TO 202101022359]"


def test_tables(spark, tmp_path):
    """Vectors, chunks, appended rows and training history are written and read back."""
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    papers.write_embeddings(vectors, f"{tmp_path}/v")
    with pytest.raises(Exception, match="already exists"):
        papers.write_embeddings(vectors, f"{tmp_path}/v")
    stored = papers.read_embeddings(spark, f"{tmp_path}/v")
    candidates = spark.createDataFrame([("c2", 0.5, 1), ("c1", 0.4, 2)], "chunk_id string, lex_score double, lex_rank int")
    assert {r.chunk_id: r.dense for r in dense.dense_scores(candidates, stored, [1.0, 0.0]).collect()} == {"c1": 1.0, "c2": 0.0}
    chunks = spark.createDataFrame([("a_s0_c0", "a", " text ")], "chunk_id string, doc_id string, text string")
    write_chunks(chunks, f"{tmp_path}/c", layout="json")
    assert read_chunks(spark, f"{tmp_path}/c").first().text == "text"
    for _ in range(2):
        append_new(chunks, f"{tmp_path}/n", "chunk_id")
    assert spark.read.parquet(f"{tmp_path}/n").count() == 1
    for i in (1, 2):
        (tmp_path / f"h{i}.json").write_text(f'{{"epoch": 0, "train": {i}.5, "valid": 0.5}}\n')
    assert [(r.run, r.train) for r in papers.load_history(spark, f"{tmp_path}/h1.json", f"{tmp_path}/h2.json").orderBy("run").collect()] == [(0, 1.5), (1, 2.5)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        papers.load_history(spark, f"{tmp_path}/none.json")


def test_candidates_without_vectors(spark):
    candidates = spark.createDataFrame([("c1", 0.5, 1), ("c2", 0.4, 2)], "chunk_id string, lex_score double, lex_rank int")
    vectors = spark.createDataFrame([("c2", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="no vector of candidate c1"):
        dense.dense_scores(candidates, vectors, [1.0, 0.0]).collect()
    last = dense.rerank(dense.dense_scores(candidates, vectors, [1.0, 0.0], missing="last"), "dense")
    assert [(r.chunk_id, r.score) for r in last.orderBy("rank").collect()] == [("c2", 1.0), ("c1", -1.0)]


def test_split_and_batches(spark):
    """Exactly a share is valid, those with the lowest hashes; batches are whole, and each row is in one at most."""
    rows = spark.range(1003).select(F.col("id").alias("chunk_id"))
    found = vocab.train_valid(rows).withColumn("h", F.xxhash64(F.lit(42), "chunk_id")).toPandas()
    valid = found[found.part == "valid"]
    assert len(valid) == 200 and valid.h.max() < found[found.part == "train"].h.min()
    assert vocab.train_valid(rows.limit(0)).count() == 0 and vocab.train_valid(rows.limit(3)).filter("part = 'valid'").count() == 0
    batches = vocab.batched(rows, 64).toPandas()
    assert batches.groupby("batch").size().tolist() == [64] * 15 and batches.chunk_id.is_unique
    again, other = vocab.batched(rows, 64).toPandas(), vocab.batched(rows, 64, epoch=1).toPandas()
    key = ["batch", "place"]
    assert again.sort_values(key).chunk_id.tolist() == batches.sort_values(key).chunk_id.tolist() != other.sort_values(key).chunk_id.tolist()


def test_random_windows(spark):
    """A window's start depends on the key alone, lies within the ids, and differs between keys."""
    df = spark.range(200).select("id", F.sequence(F.lit(2), F.lit(31)).cast("array<long>").alias("ids"))
    start = vocab.crop_start(F.col("id"), F.col("ids"), 10)
    inputs, mask = vocab.padded(F.col("ids"), 10, start)
    found = df.select(start.alias("s"), inputs.alias("x"), mask.alias("m")).collect()
    assert {r.s for r in found} == set(range(21)) and all(list(r.x) == list(range(2 + r.s, 12 + r.s)) and sum(r.m) == 10 for r in found)


def test_reports_of_either_shape(spark):
    chunks = spark.createDataFrame([(1, "p", "s"), (2, "q", "t")], "chunk_id int, doc_id string, section string")
    matches = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "chunk_id int, score double, rank int")
    meta = spark.createDataFrame([("p", "P"), ("q", "Q")], "doc_id string, title string")
    assert [(r.rank, r.doc_id) for r in pooling.any_report(matches, meta, chunks, 1).collect()] == [(1, "p")]
    assert [r.title for r in pooling.any_report(pooling.papers(matches, chunks), meta, chunks).orderBy("rank").collect()] == ["P", "Q"]
    with pytest.raises(TypeError):
        pooling.any_report(meta, meta, chunks)


def test_shared_folder(spark, monkeypatch):
    df = shared.materialized(spark.range(3).toDF("x"))
    path = shared.made()[-1]
    assert df.count() == 3 and path in shared.made()
    shared.removed(spark, [path])
    assert path not in shared.made()
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(path)

    class Remote:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Remote)


def test_report_of_the_corpus(spark):
    docs = spark.createDataFrame([("a " * 40,), ("b",)], "text string")
    row = corpus.corpus_report(docs, corpus.quality_filtered(docs)).first()
    assert (row.total_chunks, row.kept_chunks, row.kept_percent) == (2, 1, 50.0)
