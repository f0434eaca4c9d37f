"""The corpus pipeline against its stages done plainly, and the registration."""

import base64
import random

import cases
import numpy as np
import pyarrow as pa
from test_dedup import groups_by_rows, pairs_without_variant, repeated_ids

import corpus_pipeline
from pagelake.llm import bpe, decontam, lines, quality, simhash
from pagelake.llm import common as C

SF = "/root/testdata/sf0.001"


def plain_run(spark, rows, names, model, items):
    """doc_id -> text of what is left after four stages, one document at a time."""
    docs = [dict(zip(names, r)) for r in rows]
    keep = model.predict(quality.statistics(*C.text_bytes(pa.array([d["text"] for d in docs]))))[1] >= 0.5
    docs = [d for d, k in zip(docs, keep) if k]
    cut = cases.without_repeated_lines([(d["doc_id"], d["text"]) for d in docs], lines.WORDS)
    left = []
    for d in docs:
        text = cut.get((d["doc_id"], d["text"]), d["text"])
        if text == d["text"] or text.strip(" \n\t\r\v\f"):
            left.append((d["doc_id"], text))
    sigs, some = simhash.signatures(*C.text_bytes(pa.array([t for _, t in left])))
    own = np.flatnonzero(some)
    pairs = [(left[a][0], left[b][0]) for k, a in enumerate(own) for b in own[k + 1 :][simhash.distances(sigs[own[k + 1 :]], sigs[a]) <= simhash.MAX_BITS]]
    group = cases.groups_of(pairs, [i for i, _ in left])
    near = [(i, t) for i, t in left if group[i] == i]
    index = decontam.Index(items)
    bad = set(index.leaks(*C.text_bytes(pa.array([t for _, t in near])))[0].tolist())
    return {i: t for k, (i, t) in enumerate(near) if k not in bad}


def test_pipeline_against_plain_stages(spark):
    import tiktoken

    docs = C.read(spark, SF, "documents")
    model = quality.fit(docs, C.read(spark, SF, "labels"))
    items = [tuple(r) for r in C.read(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = plain_run(spark, [tuple(r) for r in docs.collect()], docs.columns, model, items)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    # the search for near copies is approximate: a group may keep a few documents more
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.02 * len(want) + 1
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == other.encode_ordinary(t) for i, t in want.items())
    assert 0.5 * docs.count() < len(want) < docs.count()


def test_pipeline_keeps_one_of_each_near_pair(spark, tmp_path):
    """Pairs within MAX_BITS that share no variant; nothing is labelled, and no line repeats."""
    rows = [cases.row(k, t) for k, t in enumerate(pairs_without_variant(random.Random(22), 6))]
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for name, there in (("labels", "false"), ("benchmark", "true")):
        C.read(spark, SF, name).where(there).write.parquet(str(tmp_path / f"{name}.parquet"))
    sigs, _ = simhash.signatures(*C.text_bytes(pa.array([r[1] for r in rows])))
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if simhash.distances(sigs[a], sigs[b]) <= simhash.MAX_BITS]
    want = set(cases.groups_of(near, range(len(rows))).values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want and len(want) <= 6


def test_pipeline_links_by_every_row_of_an_id(spark, tmp_path):
    """Documents of two texts, of which either may be near another document's; nothing is labelled, and no line repeats."""
    seen, rows = set(), []
    for r in repeated_ids(random.Random(24)):
        rows += [r] if r[1] not in seen else []
        seen.add(r[1])
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for name, there in (("labels", "false"), ("benchmark", "true")):
        C.read(spark, SF, name).where(there).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = groups_by_rows(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in rows if want[r[0]] == r[0]) and len(got) < len(rows) / 2


def test_stages_keep_columns_and_take_awkward_rows(spark):
    rows = cases.nasty()
    docs = cases.frame(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        assert docs.count() > 20
    empty = cases.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_sql_twins(spark, duck, sf_dir):
    from conftest import same_rows

    from pagelake.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert same_rows(queries.QUERIES[name](spark, sf_dir), duck.sql(sql)), name
