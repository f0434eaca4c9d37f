"""Cleaning and spelling on small texts; pipeline, sources and sinks."""

import pytest

from pagelake import Pipeline
from pagelake.operators import clean, spell
from pagelake.plans import cli
from pagelake.plans.registry import Registry, recognizers
from pagelake.schema import DICTIONARY, LINES, PAGES, REGIONS
from pagelake.sources import dictionary, files
from pagelake.streaming import pages as stream


def cleaned(spark, *rows):
    data = []
    for k, r in enumerate(rows):
        text, y0, y1, x0, x1 = (*r, *(22 * k, 22 * k + 20, 0, 400)[len(r) - 1 :])
        data.append((1, 0, k, x0, y0, x1, y1, text, 1.0))
    got = clean.clean(spark.createDataFrame(data, LINES)).collect()
    return got[0].text if got else ""


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("com-",), ("plete the",)], "complete the"),
        ([("impor-",), ("tant news",)], "important news"),
        ([("New-",), ("York is great",)], "New-\n\nYork is great"),
        ([("The quick brown",), ("fox jumped over",)], "The quick brown fox jumped over"),
        ([("First line of",), ("a very long paragraph",), ("that keeps going on.",)], "First line of a very long paragraph that keeps going on."),
        ([("The story ended.",), ("Another story began.",)], "The story ended.\n\nAnother story began."),
        ([("something -",), ("or other text",)], "something - or other text"),
        ([("one", 0, 20), ("two", 80, 100)], "one\n\ntwo"),
        ([("one", 0, 20, 0, 180), ("two", 22, 42, 220, 400)], "one\n\ntwo"),
        ([("The govern-", 0, 20), ("ment decided", 22, 42), ("to act quickly.", 44, 64), ("Meanwhile the", 130, 150), ("crowd dispersed.", 152, 172)], "The government decided to act quickly.\n\nMeanwhile the crowd dispersed."),
        ([("First line",), ("",), ("third line",)], "First line third line"),
        ([("Just one line.",)], "Just one line."),
        ([("",), ("  ",)], ""),
    ],
)
def test_clean(spark, rows, want):
    assert cleaned(spark, *rows) == want


def test_paragraphs(spark):
    lines = spark.createDataFrame([(1, 0, k, 0, 22 * k, 400, 22 * k + 20, t, 1.0) for k, t in enumerate(("One.", "Two goes", "on."))], LINES)
    assert [r.text for r in clean.paragraphs(lines).orderBy("para_idx").collect()] == ["One.", "Two goes on."]


TERMS = [("receive", 100), ("the", 900), ("soldier", 50), ("government", 70), ("abcd", 5), ("abce", 9)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("receeve", "receive"), ("RECEEVE", "RECEIVE"), ("Receeve", "Receive"), ("Receeve,", "Receive,"), ('"Receeve"', '"Receive"'), ("an I 1856 McClellan", "an I 1856 McClellan"),
        ("teh  soldir", "the  soldier"), ("abcf", "abce"), ("zzzzzzz", "zzzzzzz"), ("receive", "receive"), ("", ""),
    ],
)
def test_spell(spark, text, want):
    regions = spark.createDataFrame([(1, 0, text)], "page_id long, region_idx int, text string")
    terms = spark.createDataFrame(TERMS, DICTIONARY)
    assert spell.check(regions, terms).first().text == want
    assert spell.check(regions, terms, enabled=False).first().text == text


def test_corrections_log(spark):
    regions = spark.createDataFrame([(1, 0, "receeve RECEEVE Receeve zymble")], "page_id long, region_idx int, text string")
    assert spell.corrections(regions, spark.createDataFrame([*TERMS, ("zymble", 1000)], DICTIONARY)).count() == 3


def test_distance_is_optimal_string_alignment():
    assert [spell._osa(a, b, 9) for a, b in (("ca", "abc"), ("teh", "the"), ("", "ab"), ("same", "same"))] == [3, 1, 2, 0]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("zymble 1000\nzymble 5\nbad line\n\nterm 7 more\n")
    assert {tuple(r) for r in dictionary.read_dictionary(spark, str(tmp_path / "d.txt")).collect()} == {("zymble", 1005), ("term", 7)}
    docs = spark.createDataFrame([("One one ONE two",), (None,), ("",)], "text string")
    assert [tuple(r) for r in dictionary.corpus_dictionary(docs, 3).collect()] == [("one", 3)]


def test_registry_and_cli(tmp_path, capsys):
    r = Registry("thing")
    r.register("b", 1)
    r.register("a", 2)
    assert r.list() == ["a", "b"] and r.get("a") == 2
    with pytest.raises(KeyError, match="a, b"):
        r.get("c")
    with pytest.raises((ImportError, NotImplementedError)):
        recognizers.get("kraken")()
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    assert cli.main([str(tmp_path / "missing.jp2")]) == 2


def test_pipeline_end_to_end(spark):
    pages = spark.createDataFrame([(1, "p", 500, 500), (2, "q", 500, 500)], PAGES)
    regions = spark.createDataFrame([(1, 0, "article", 0, 0, 400, 100, "", 1.0)], REGIONS)
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 400, 20, "The govern-", 1.0), (1, 0, 1, 0, 22, 400, 42, "ment receeved", 0.2)], LINES)
    terms = spark.createDataFrame([*TERMS, ("received", 80)], DICTIONARY)
    run = lambda **k: {r.page_id: r.result for r in Pipeline(**k).run(pages, regions, lines).collect()}
    assert run() == {1: "The government receeved", 2: ""}
    assert run(dictionary=terms)[1] == "The government received"
    assert "ocr_line" in run(output="hocr")[1]
    assert run(layout_processing=True)[1] == "The government receeved"
    with pytest.raises(KeyError):
        Pipeline(output="pdf")


def test_files(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.png").write_bytes(b"x" + n.encode())
    paths = [str(tmp_path / "b.png"), str(tmp_path / "a.png")]
    got = files.read_images(spark, paths).orderBy("ord").collect()
    assert [bytes(r.content) for r in got] == [b"xb", b"xa"]
    done = spark.createDataFrame([("in/a.jp2", "text of a"), ("in/b.jp2", "text of b")], "path string, result string")
    assert files.write_pages(done, str(tmp_path / "out"), "text") == 2
    assert (tmp_path / "out" / "a.txt").read_text() == "text of a"
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.find_model("m.onnx", model_dir=str(tmp_path / "nowhere"), cache="")
    assert files.image_rows(spark, [b"1", b"2"]).count() == 2
    assert b"Text Recognition:" in files.ModelService("http://x", "m").body(b"png")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, 400, 20, "com-", 1.0), (1, 0, 1, 0, 22, 400, 42, "plete", 1.0)], LINES)
    rows.write.parquet(str(tmp_path / "in"))
    stream.run(spark, str(tmp_path / "in"), LINES, clean.clean, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["complete"]
