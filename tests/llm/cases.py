"""Awkward documents, and plain-Python versions of the operators to hold them against."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, `key` long, start int, score double, removed_lines int, ids string, h long, first string, toxic string"
WORDS = "the of and tion ing heble ander stor rea nly whenn othe éau ñado ßig x 42 don't l'été".split()


def prose(rng: random.Random, n: int, lines: int = 1) -> str:
    out = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(out[k : k + step]) for k in range(0, n, step))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "w", 1, 2, 0.5, 3, "ids", 4, "f", "t")


def nasty(seed: int = 1, items: tuple[str, ...] = ()) -> list[tuple]:
    """Nulls, empty and blank texts, very long ones, ties, equal and repeated rows, shared passages and lines."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 90), rng.randint(1, 8)) for _ in range(25)]
    rows = [row(k, t, rng.choice(["en", "de", None, "xx"])) for k, t in enumerate(base)]
    shared = prose(rng, 60, 6)
    rows += [row(100 + k, prose(rng, 20, 2) + "\n" + shared + "\n" + prose(rng, rng.randint(0, 20), 2)) for k in range(4)]
    rows += [row(200, base[3]), row(201, base[3]), row(201, base[3]), row(3, base[3])]  # copies, a repeated row
    rows += [row(300, shared + "\n" + shared), row(301, "same\nlines\nhere\n" * 4), row(302, "a " * 40)]
    rows += [row(None, base[5]), row(None, None), row(400, None), row(401, ""), row(402, " \n\t\r\n "), row(403, "\n\n"), row(404, "é"), row(405, "'s"), row(406, "!" * 500)]
    rows.append(row(500, prose(rng, 30_000, 600)))  # very long
    words = base[7].split(" ")
    words[len(words) // 2] = "changed"
    rows.append(row(501, " ".join(words)))  # a near copy
    rows += [row(600 + k, prose(rng, 5) + " " + item + " " + prose(rng, 5)) for k, item in enumerate(items)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# plain versions

SPACE = " \t\n\r\v\f"


def split_words(text: str) -> list[tuple[str, int, int]]:
    out, k = [], 0
    while k < len(text):
        if text[k] in SPACE:
            k += 1
            continue
        j = k
        while j < len(text) and text[j] not in SPACE:
            j += 1
        out.append((text[k:j], k, j))
        k = j
    return out


def repeated_spans(rows, size: int) -> set[tuple]:
    places: dict = {}
    docs = {(r[0], r[1]) for r in rows if r[0] is not None and r[1]}
    for i, t in docs:
        w = split_words(t)
        for k in range(len(w) - size + 1):
            places.setdefault(tuple(x[0] for x in w[k : k + size]), []).append((i, w[k][1], w[k + size - 1][2]))
    later: dict = {}
    for found in places.values():
        first = min(found)
        for i, s, e in found:
            if (i, s, e) != first:
                later.setdefault(i, []).append((s, e, first[0]))
    out = set()
    for i, spans in later.items():
        spans.sort()
        start, end, source = spans[0]
        for s, e, f in spans[1:]:
            if s > end:
                out.add((i, start, end, source))
                start, end, source = s, e, f
            else:
                end = max(end, e)
        out.add((i, start, end, source))
    return out


def without_repeated_lines(rows, words: int) -> dict:
    """Text by (doc_id, text) after deletion of the least runs of lines with so many words that occurred earlier."""
    blank = " \t\r\v\f"
    places: dict = {}
    for i, t in {(r[0], r[1]) for r in rows if r[0] is not None and r[1]}:
        full = [x.strip(" \t\r\v\f") for x in t.split("\n") if x.strip(blank)]
        for k in range(len(full)):
            run, n = 0, 0
            while n < words and k + run < len(full):
                n += len(split_words(full[k + run]))
                run += 1
            if n >= words:
                places.setdefault(tuple(full[k : k + run]), []).append((i, k, t))
    gone: dict = {}
    for run, found in places.items():
        first = min(found)[:2]
        for i, k, t in found:
            if (i, k) != first:
                gone.setdefault((i, t), set()).update(range(k, k + len(run)))
    out = {}
    for (i, t), lost in gone.items():
        kept, k = [], 0
        for line in t.split("\n"):
            if line.strip(blank):
                if k not in lost:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        out[i, t] = "\n".join(kept)
    return out


def fitted_edits(piece: str, text: str) -> int:
    """Least edits between the piece and any part of the text."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(piece, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[j - 1] + 1))
        last = now
    return min(last)


def groups_of(pairs, ids) -> dict:
    """Least id connected with each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
