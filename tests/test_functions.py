"""The plain functions and the sources on small cases."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import latex as tex
from palimpsest.functions import text as tx
from palimpsest.operators import corpus, dense, pooling, vocab
from palimpsest.sources import papers
from palimpsest.streaming.ingest import PROCESSED, stream_chunks


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_chunks_cover_the_words_in_order(text, size, overlap):
    pieces = corpus.split_chunks(text, size, overlap)
    assert all(p == p.strip() for p in pieces)
    assert pieces[0] == "" or text.strip().startswith(pieces[0][:1])
    if overlap == 0 and len(text.strip()) > size:
        assert " ".join(" ".join(pieces).split()) == " ".join(text.split())


def test_chunk_edges():
    assert corpus.split_chunks("x" * 10, 10) == ["x" * 10]
    assert corpus.split_chunks("x" * 50, 10, 0) == ["x" * 50]
    assert corpus.split_chunks(None) == [""]
    assert corpus.split_chunks("a b", 0) == ["a b"]


def test_latinize(spark):
    words = ["Straße", "Œuvre", "naïve", "Łódź", "plain", "日本", "ﬁnite … ½ ＡＢ ① ℃ 𝐀", "e\u0301", "", None]
    words += [chr(c) + "x" for c in range(0x80, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r[0] for r in df.select(tx.latinize(F.col("t"))).collect()] == [None if w is None else tx.plain(w) for w in words]


CASES = {
    r"a \textbf{b} \cite{x,y}.": "a b CITE.",
    r"$x$ and $E=mc^2$ or $3D$": "x and MATH or 3D".lower().replace("math", "MATH"),
    r"\begin{equation} a \end{equation} then": "EQN then",
    r"\begin{figure} never closed": "FIG",
    r"in 2021 we see 3 and SU2": "in NUM we see 3 and su2",
    r"\ensuremath{a{b}c} x": "MATH x",
    r"see \ref{a} and \cite{b}": "see REF",
    "caf\u00e9 ~ x": "cafe x",
    r"\'etude": "etude",
}


@pytest.mark.parametrize("latex", sorted(CASES))
def test_cleaning(latex):
    assert tex.cleaned(latex) == CASES[latex]


def test_long_braced_argument_is_no_problem():
    assert tex.cleaned("a \\section{" + "x" * 200_000 + "} b") == "a b"


def test_macros():
    m = tex.macros_of(r"\newcommand{\a}{A} \newcommand\b[2]{#1} \def\c#1\d{x} \newenvironment{e}{\begin{equation}}{\end{equation}} \newcommand{\a}{B} \def\section{no}")
    assert (m.noarg, m.arg, m.env, m.delim) == ({"a": "A"}, {"b": 2}, {"e": "equation"}, {"c": "d"})
    assert tex.expanded(r"\a \b{1}{2} \c z \d \begin{e}", m) == r"A  @@env@@   @@env@@  \begin{equation}"
    assert m.merged(tex.Macros({"a": "Z", "q": "Q"})).noarg == {"a": "A", "q": "Q"}
    assert tex.macros_of(r"\@startsection \textwidth \newcommand{\a}{A}", package=True) == tex.Macros()


def test_sections_stop_and_skip():
    found = tex.sections_of(r"intro \section{One} a \section{Acknowledgments} b \section*{Two} c \section{References} d")
    assert found == [{"title": "One", "text": "a"}, {"title": "Two", "text": "c"}]
    assert tex.sections_of("no  heading") == [{"title": "", "text": "no heading"}]


def _archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_and_inputs(spark, tmp_path):
    good = _archive({"main.tex": b"\\begin{document}\r\n\\section{A} x \\input{part/one} \\input{part/one} \\input{../up}\r\n\\end{document}", "part/one.tex": b"one", "../up.tex": b"secret"})
    for name, data in (("p1", good), ("p2", b"not an archive")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "source.tar.gz").write_bytes(data)
    found = papers.read_archives(spark, str(tmp_path / "*" / "source.tar.gz")).collect()
    assert [r.doc_id for r in found] == ["p1"] and "\r" not in found[0].files["main.tex"] and set(found[0].files) == {"main.tex", "part/one.tex"}
    assert tex.paper_sections(dict(found[0].files)) == [{"title": "A", "text": "x one"}]


def test_metadata_lines(spark, tmp_path):
    lines = [json.dumps({"arxiv_id": "1", "title": "old"}), "broken", json.dumps({"title": "none"}), json.dumps({"arxiv_id": "1", "title": "new"})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    assert [(r.arxiv_id, r.title) for r in papers.read_metadata(spark, str(tmp_path / "m.jsonl")).collect()] == [("1", "new")]
    assert papers.read_metadata(spark, str(tmp_path / "absent.jsonl")).count() == 0


def test_feed(spark):
    xml = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2101.00001v2</id><title> A
 title </title><summary> s </summary><author><name>N One</name></author><category term="hep-th"/><category term="gr-qc"/><published>2021-01-01</published><updated>2021-01-02</updated></entry>
<entry><id>http://x/abs/2101.00002v1</id><title>B</title><summary>t</summary><author><name>M</name></author><category term="gr-qc"/><published>p</published><updated>u</updated></entry></feed>"""
    pages = spark.createDataFrame([(xml,)], "xml string")
    one = papers.parse_feed(pages, "hep-th").collect()
    assert [(r.arxiv_id, r.title, r.authors, r.categories) for r in one] == [("2101.00001", "A title", ["N One"], ["hep-th", "gr-qc"])]
    assert papers.parse_feed(pages, "hep-th", include_crosslists=True).count() == 2
    assert papers.date_window("2021-01-01", "2021-01-31") == ("202101010000", "202101312359")
    with pytest.raises(ValueError):
        papers.date_window("2021-02-01", "2021-01-31")


def test_rerank(spark):
    scored = spark.createDataFrame([(i, 1.0 - i / 10, i + 1, d) for i, d in enumerate([0.1, 0.95, 0.3, 0.85, 0.9])], "chunk_id int, lex_score double, lex_rank int, dense double")
    order = lambda **k: [r.chunk_id for r in dense.rerank(scored, **k).orderBy("rank").collect()]
    assert order(method="tfidf") == [0, 1, 2, 3, 4]
    assert order(method="dense") == [1, 4, 3, 2, 0]
    assert order(method="pin_top", k_pinned=2) == [0, 1, 4, 3, 2]
    assert order(method="pin_top", k_pinned=3) == [0, 1, 2, 3, 4]  # 3 and 4 reach the cap of 0.8
    assert order(method="pin_top", k_pinned=0) == order(method="score_fusion", alpha=0.0) == order(method="dense")
    assert order(method="score_fusion", alpha=1.0) == order(method="tfidf")
    with pytest.raises(ValueError):
        dense.rerank(scored, "other")


def test_find_and_split(spark):
    matches = spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 2), ("b", 0.3, 3)], "doc_id string, score double, rank int")
    assert {(r.doc_id, r.present, r.best_rank) for r in pooling.find(matches, ["a", "z"]).collect()} == {("a", True, 1), ("z", False, None)}
    parts = vocab.train_valid(spark.range(101).withColumnRenamed("id", "chunk_id")).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 81, "valid": 20}


def test_stream_sees_each_file_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    row = lambda i: spark.createDataFrame([(f"d{i}", "t", [("s", "word " * 400), ("", " ")])], PROCESSED)
    for turn in range(2):
        row(turn).write.mode("append").parquet(source)
        stream_chunks(spark, source, sink, checkpoint).awaitTermination(60)
        assert spark.read.parquet(sink).select("doc_id").distinct().count() == turn + 1
