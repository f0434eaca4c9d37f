"""Truncation of repetitions over whole documents, against trying every period."""

from pagelake import queries as core


def plain(text):
    for n in range(10, len(text) // 2 + 1):
        if text[:n] == text[n : 2 * n]:
            return text[:n].strip()
    return text.strip()


def test_documents(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(9_000))
    assert len(long) > 40_000
    texts = [None, "", "é" * 9, "ab" * 40, "Hello world " * 5, long, long + long, long + " and no more", " x" + long[:45_000] * 2 + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in core.QUERIES["repetition_truncate"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else plain(t) for k, t in enumerate(texts)}


def test_driver_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in core.QUERIES["repetition_truncate"](spark, sf_dir).collect()}
    assert got == {k: None if t is None else plain(t) for k, t in docs.items()}
