"""Spelling variants against a brute-force search, and the index by itself."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelrisk.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, drop=31, least=7, times=2):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if drop and d is not None and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= times}


def brute_forms(words, times=10):
    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: (x[0][1] if x and -x[0][0] >= times * words[w] else None) for w, x in near.items()}
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def mutate(rng, w, letters):
    i = rng.randrange(len(w) + 1)
    return rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w])


@pytest.mark.parametrize("letters", ["ab", "abcdefghijé×ÿ"])
def test_index_finds_every_near_word(letters, monkeypatch):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(40)]
    words = sorted({mutate(rng, rng.choice(base), letters) for _ in range(300)} - {""})
    queries = sorted({*words, "zzzzzzzz", "a", base[0] + "Z"})

    def flat(x):
        return np.array([ord(c) for w in x for c in w], np.int64), np.r_[0, np.cumsum([len(w) for w in x])]

    want = {(q, w) for q in queries for w in words if one_edit(q, w) and w.startswith(q[: len(q) // 2])}
    for table in (1 << 24, 0):
        monkeypatch.setattr(spelling, "TABLE", table)
        monkeypatch.setattr(spelling, "STATES", 100)
        a, b = spelling.Index(*flat(words)).near(*flat(queries), np.array([len(q) // 2 for q in queries]))
        got = [(queries[i], words[j]) for i, j in zip(a, b)]
        assert set(got) == want and len(got) == len(want)


def test_checksums_and_runs():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aZÃéÿĀ -") for _ in range(rng.randrange(30))) for _ in range(50)] + ["x" * 5000, "", "×÷"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    begin, end, points = spelling.letter_runs(data, offsets)
    body = data.tobytes()
    assert [body[a:b].decode() for a, b in zip(begin, end)] == [x for t in texts for x in RUN.findall(t)]
    assert [len(body[a:b].decode()) for a, b in zip(begin, end)] == points.tolist()
    lead = np.arange(len(begin), dtype=np.uint32) * 77
    assert spelling.crc32_spans(data, begin, end, lead).tolist() == [zlib.crc32(body[a:b], int(x)) for a, b, x in zip(begin, end, lead)]


def test_words_and_forms_of_documents(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 14))) for _ in range(60)]
    heavy = [base[int(60 * rng.random() ** 4)] for _ in range(6000)] + [mutate(rng, rng.choice(base), "abcÉ") for _ in range(1500)]
    rng.shuffle(heavy)
    rows = [(i, " ".join(w.title() if rng.random() < 0.2 else w for w in heavy[25 * i : 25 * i + 25])) for i in range(300)]
    rows += [(None, base[0] + " " + base[1]), (3, rows[3][1]), (900, None), (901, ""), (902, "l" * 30000 + " " + "l" * 30000 + " " + "l" * 29999), (903, "l" * 29999)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, word string, n int").repartition(4)
    counted = spelling.count_words(docs, drop_every=31)
    words = brute_words(rows)
    assert dict(map(tuple, counted.collect())) == words
    assert sorted(map(tuple, spelling.variant_forms(counted).collect())) == brute_forms(words)
    assert dict(map(tuple, spelling.count_words(docs, 5, 1).collect())) == brute_words(rows, 0, 5, 1)


def test_many_shards_and_units(spark):
    """One beginning and one end hold most words: their shards are asked by many units."""
    rng = random.Random(6)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(500)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) + "suffix" for _ in range(300)}
    rows = [(w, rng.randrange(2, 400)) for w in sorted(words)]
    frame = spark.createDataFrame(rows, "word string, n long")
    got = sorted(map(tuple, spelling.near_words(frame, shard=40, unit=50).collect()))
    assert got == sorted((a, b, n) for a in words for b, n in rows if one_edit(a, b))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_forms(spelling.count_words(docs)).count() == 0
