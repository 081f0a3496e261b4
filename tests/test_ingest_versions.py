"""Ingest by content: replay, change and failure leave every chunk of the latest version once."""

import os
import tempfile

import pytest

from quayside.streaming import ingest as I


def put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name.replace("_", ".")), "w") as fh:
            fh.write(text)


def chunks(spark, out):
    return sorted((r.filename, r.chunk_index, r.content) for r in I.current_chunks(spark, out).collect())


@pytest.fixture
def place():
    base = tempfile.mkdtemp(prefix="versions-")
    return os.path.join(base, "in"), os.path.join(base, "ck"), os.path.join(base, "out")


def run(spark, place, **kw):
    src, ck, out = place
    q = I.ingest_versions(spark, os.path.join(src, "*"), ck, out, **kw)
    q.awaitTermination()


def test_changed_files_replace_their_chunks(spark, place):
    src, _, out = place
    put(f"{src}/d1", a_md="one\n\ntwo\n\nthree", b_html="<p>hello</p>", c_txt="soon")
    run(spark, place, max_chars=5)
    assert chunks(spark, out) == [("a.md", 0, "one"), ("a.md", 1, "two"), ("a.md", 2, "three"),
                                  ("b.html", 0, "hello"), ("c.txt", 0, "soon")]
    # shorter text, same text, no text, new file
    put(f"{src}/d2", a_md="four", b_html="<p>hello</p>", c_txt="\n", d_md="new")
    run(spark, place, max_chars=5)
    assert chunks(spark, out) == [("a.md", 0, "four"), ("b.html", 0, "hello"), ("d.md", 0, "new")]
    epochs = {r.filename: r.epoch for r in I.current_chunks(spark, out).collect()}
    assert epochs == {"a.md": 1, "b.html": 0, "d.md": 1}      # equal content keeps its version
    # back to an earlier content is a change too
    put(f"{src}/d3", a_md="one\n\ntwo\n\nthree", c_txt="back")
    run(spark, place, max_chars=5)
    assert chunks(spark, out) == [("a.md", 0, "one"), ("a.md", 1, "two"), ("a.md", 2, "three"),
                                  ("b.html", 0, "hello"), ("c.txt", 0, "back"), ("d.md", 0, "new")]
    before = chunks(spark, out)
    run(spark, place, max_chars=5)                            # nothing new
    assert chunks(spark, out) == before


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_failing_batch_is_run_again(spark, place, monkeypatch, when):
    src, _, out = place
    put(f"{src}/d1", a_md="one\n\ntwo", b_md="kept")
    run(spark, place)
    put(f"{src}/d2", a_md="three")
    write, calls = I.write_version, []

    def failing(*args, **kw):
        calls.append(args[3])
        if when == "after":
            write(*args, **kw)
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "write_version", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, place)
    monkeypatch.setattr(I, "write_version", write)
    run(spark, place)
    assert calls == [1]
    assert chunks(spark, out) == [("a.md", 0, "three"), ("b.md", 0, "kept")]
    assert spark.read.parquet(out).count() == 3


def test_the_same_epoch_written_twice(spark, place):
    out = place[2]
    files = spark.createDataFrame([("a.md", "x", 1, "p1"), ("a.md", "y", 2, "p0"), ("n.md", None, 1, "p2")],
                                  "filename string, raw string, seen long, path string")
    for _ in range(2):
        I.write_version(spark, files, out, 0)
        assert chunks(spark, out) == [("a.md", 0, "y")]       # the one seen last, once
    I.write_version(spark, files, out, 1)                     # nothing changed
    assert chunks(spark, out) == [("a.md", 0, "y")] and spark.read.parquet(out).count() == 2


def test_files_changed_in_place(spark, place):
    src, _, out = place
    put(src, a_md="one", b_md="two")
    assert I.ingest_folder(spark, src, out) == 0
    put(src, a_md="changed")
    assert I.ingest_folder(spark, src, out) == 1
    assert chunks(spark, out) == [("a.md", 0, "changed"), ("b.md", 0, "two")]
    # epochs whose scan finds no change add nothing
    I.ingest_folder(spark, src, out)
    assert chunks(spark, out) == [("a.md", 0, "changed"), ("b.md", 0, "two")]
    assert spark.read.parquet(out).count() == 3


def test_nothing_ingested_yet(spark, place):
    assert chunks(spark, place[2]) == []
