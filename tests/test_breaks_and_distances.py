"""Breaks after a short last line, edit distances with swaps, and files whose names end alike."""

import random

from pagelake.operators import clean, spell
from pagelake.schema import LINES
from pagelake.sources import files


def test_short_line_that_ends_a_sentence(spark):
    def broken(first, second, x1=100, other=400):
        rows = [(1, 0, 0, 0, 0, x1, 20, first, 1.0), (1, 0, 1, 0, 22, other, 42, second, 1.0)]
        return clean.glue(spark.createDataFrame(rows, LINES)).where("line_idx = 1").first().broken

    assert broken("The story ended.", "Another began")
    assert not broken("The story ended.", "Another began", x1=380) and not broken("The story ended.", "another began") and not broken("The story ended", "Another began")
    assert not broken("", "Another began") and broken("Who? ", " Élan!")


def plain(a, b):
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_distances_with_swaps():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9)))
    for most in (1, 2, 3):
        pairs = [(a, b) for a, b in ((word(), word()) for _ in range(3000)) if abs(len(a) - len(b)) <= most]
        found = spell._distances([a for a, _ in pairs], [b for _, b in pairs], most)
        assert [min(int(x), most + 1) for x in found] == [min(plain(a, b), most + 1) for a, b in pairs]


def test_nearest_against_trying_every_term(spark):
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))): rng.randint(1, 5) for _ in range(150)}
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(120)}
    for distance in (1, 2):
        want = {}
        for w in words:
            near = [(plain(w, t), -n, t) for t, n in terms.items() if plain(w, t) <= distance]
            if near:
                want[w] = (min(near)[2], min(near)[0])
        got = spell.nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, count long"), distance)
        assert {r.word: (r.term, r.distance) for r in got.collect()} == want and len(want) > 20


def test_names_that_end_alike(spark, tmp_path):
    for name in ("a.png", "ba.png", "c d.png"):
        (tmp_path / name).write_bytes(name.encode())
    paths = [str(tmp_path / x) for x in ("ba.png", "a.png", "c d.png", "a.png")]
    got = files.read_images(spark, paths).orderBy("ord").collect()
    assert [(r.ord, bytes(r.content)) for r in got] == [(0, b"ba.png"), (1, b"a.png"), (2, b"c d.png"), (3, b"a.png")]


def test_no_deletions_in_a_broadcast(spark, tmp_path):
    """From small files, too: a word has hundreds of shorter forms, of which the planner knows nothing."""
    rng = random.Random(5)
    terms = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    words = [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for t in terms for i in (1, 5)]
    spark.createDataFrame([(t, 7) for t in terms], "term string, count long").write.parquet(f"{tmp_path}/terms")
    spark.createDataFrame([(w,) for w in words], "word string").write.parquet(f"{tmp_path}/words")
    for distance in (1, 2):
        found = spell.nearest(spark.read.parquet(f"{tmp_path}/words"), spark.read.parquet(f"{tmp_path}/terms"), distance)
        assert len(found.collect()) == len(set(words))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_swaps_alone(spark):
    """Words that are near only as swaps count once, among others with the same characters that aren't near."""
    rng = random.Random(6)
    terms = ["".join(rng.choice("abcdé𝒶") for _ in range(8)) for _ in range(60)]
    words = set()
    for t in terms:
        for swaps in (1, 2, 3):
            w = t
            for i in rng.sample(range(7), swaps):
                w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            words |= {w, w[:-1] + "x", "".join(rng.sample(t, 8))}
    for distance in (1, 2, 3):
        want = {}
        for w in words:
            if near := [(plain(w, t), t) for t in set(terms) if plain(w, t) <= distance]:
                want[w] = min(near)[::-1]
        got = spell.nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, 1) for t in set(terms)], "term string, count long"), distance)
        assert {r.word: (r.term, r.distance) for r in got.collect()} == want and len(want) > 60
