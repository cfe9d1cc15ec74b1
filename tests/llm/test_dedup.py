"""Vector, document and passage dedup against brute force, and their edge cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.llm import chunks, minhash, rabitq, textbytes
from panelrisk.llm.links import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, pool=5000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    fold = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(fold)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    edges = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * len(a | sets[j]):
                edges.append((i, j))
    group = closure(range(len(rows)), edges)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, math.inf), rows[i][0])
    return [(d, len(s), least[group[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_components_are_the_closure(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 130, 2000):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        assert minhash.sketch(s).max() < np.iinfo(np.uint64).max
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = minhash.sketch(np.r_[shared, a]), minhash.sketch(np.r_[shared, b])
    assert abs((x == y).mean() - 0.75) < 0.16


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 2, 7, 8, 9, 30, 40, 146, 200):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for drop in (0, 0.05, 0.1, 0.2, 0.4):
            kept = base[rng.random(n) >= drop]
            extra = rng.integers(0, 2**63, int(n * rng.random() * 0.4)).astype(np.uint64)
            if len(kept) + len(extra):
                sets.append(np.unique(np.r_[kept, extra]))
    open_ = {(i, int(j)) for i, js in minhash.can_link([minhash._bitmap(s) for s in sets], np.array([len(s) for s in sets]), 75) for j in js}
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                linked += 1
                assert (i, j) in open_
    assert linked > 20 and len(open_) < len(sets) * (len(sets) - 1) / 4


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    rows, base = [], words(rng, 120)
    for i in range(60):  # a family with more and more edits, so that links chain
        w = list(base)
        for _ in range(i // 6):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(rng, rng.randrange(1, 200)))) for i in range(60)]
    rows += [(200, rows[70][1].upper()), (201, rows[70][1]), (202, None), (203, ""), (204, " \n\t"), (205, "one two"), (206, "One  TWO"), (207, "one")]
    rows += [(206, "One  TWO"), (300, "a " * 5000), (301, "a " * 400), (302, "ä Ä é"), (303, "Ä ä é")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sid string, bands int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_tables(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert minhash.near_duplicates(empty).count() == 0
    assert chunks.dedup_substrings(empty).count() == 0
    assert rabitq.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_vectors(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if ok else None)
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    group = closure(range(len(rows)), edges)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, math.inf), rows[i][0])
    degree = [sum(i in e for e in edges) for i in range(len(rows))]
    return sorted((r[0], degree[i], least[group[i]]) for i, r in enumerate(rows))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(64)
            for _ in range(6):
                rows.append((n, (centre + rng.standard_normal(64) * 0.22).tolist(), label))
                n += 1
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, [2 * x for x in rows[0][1]], 0)]
    rows += [(1010, None, 0), (1011, [], 0), (1012, [0.0] * 64, 0), (1013, [None] * 64, 0), (1014, [float("nan")] + [1.0] * 63, 0)]
    rows += [(1015, [float("inf")] + [1.0] * 63, 0), (1016, [1.0, 2.0], 0), (1017, [1.0, 2.001], 0), (1018, [1e-200, 2e-200], 0), (1019, [1e200, 2e200], 0)]
    frame = spark.createDataFrame([(a, v, c, "k", 5) for a, v, c in rows], "vec_id long, embedding array<double>, label int, cid string, weight int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in rabitq.cosine_links(frame).collect())
    assert got == brute_vectors(rows)


def test_hot_group_of_vectors_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * (0.05 if i % 3 else 0.3)).tolist(), 1) for i in range(120)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in rabitq.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == brute_vectors(rows)


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    v = rabitq.unit(rng.standard_normal((300, 64)) + rng.standard_normal(64))
    code, factors = rabitq.encode(v)
    est, error = rabitq.estimate(code, factors, v)
    off = est - v @ v.T
    assert abs(off.mean()) < 0.02
    assert (np.abs(off) <= rabitq.SIGMAS * error[:, None]).all()


def test_cuts_depend_on_nearby_text_only():
    rng = random.Random(2)
    text = " ".join(words(rng, 400)).encode()

    def cuts(raw):
        data = np.frombuffer(raw, np.uint8)
        _, begin, end, _, _ = chunks._chunks(data, np.array([0, len(data)]))
        return [raw[a:b] for a, b in zip(begin, end)]

    plain, shifted = cuts(text), cuts(b"seven new words that shift all others " + text)
    assert len(set(plain) & set(shifted)) >= len(plain) - 3


def test_repeated_passages_go_but_their_first_copy_stays(spark):
    rng = random.Random(11)
    passage = " ".join(words(rng, 60))
    rows = [(i, f"{' '.join(words(rng, 80))} {passage}\n{' '.join(words(rng, 30))}") for i in range(1, 6)]
    clean = [(10 + i, " ".join(words(rng, 100, 10**6)) + " a phrase of six common words") for i in range(5)]
    odd = [(30, None), (31, ""), (32, " \n"), (33, "déjà vu"), (40, rows[0][1]), (50, clean[0][1]), (50, clean[0][1])]
    frame = spark.createDataFrame([(d, t, "a", 1, "z") for d, t in rows + clean + odd], "doc_id long, text string, _text string, digest int, `a.b` string")
    out = chunks.dedup_substrings(frame)
    assert out.columns == [*frame.columns, "removed_spans", "removed_chars"]
    got = out.collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows + clean + odd)
    assert by_id[1].text == rows[0][1] and by_id[1].removed_chars == 0
    for d, t in rows[1:]:
        assert not any(" ".join(passage.split()[i : i + 51]) in by_id[d].text for i in range(10))
        spans = by_id[d].removed_spans
        assert all(t[s.start : s.start + s.length] in rows[0][1] for s in spans) and sum(s.length for s in spans) == by_id[d].removed_chars
        kept = t
        for s in reversed(spans):
            kept = kept[: s.start] + kept[s.start + s.length :]
        assert kept == by_id[d].text
    for d, t in clean + odd[:4]:
        assert by_id[d].text == t and by_id[d].removed_chars == 0
    assert by_id[40].removed_chars > 0.8 * len(rows[0][1])  # a copy of document 1
    assert {r.a for r in out.select(F.col("`a.b`").alias("a")).collect()} == {"z"}


def test_cuts_of_a_row_do_not_depend_on_its_neighbours():
    rng = random.Random(3)
    for _ in range(20):
        check_rows_alone(rng)


def check_rows_alone(rng):
    raws = ["".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=90)).encode(), b"a b c " * 9, " ".join(words(rng, 60)).encode(), b"", b"x"]
    offsets = np.cumsum([0, *map(len, raws)])
    at, begin, _, _, digest = chunks._chunks(np.frombuffer(b"".join(raws), np.uint8), offsets)
    for i, raw in enumerate(raws):
        _, alone, _, _, own = chunks._chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert (begin[at[i] : at[i + 1]] - offsets[i]).tolist() == alone.tolist() and digest[at[i] : at[i + 1]].tolist() == own.tolist()


def test_passages_without_spaces_and_rows_without_id(spark):
    rng = random.Random(12)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)]
    text = lambda n: "".join(rng.choices(signs, k=n))
    passage, whole = text(300), text(250)
    rows = [(i, f"{text(200)}{passage}{text(150)}") for i in range(1, 6)] + [(10, whole), (11, whole), (12, text(400)), (None, whole), (None, whole)]
    got = [(r.doc_id, r.text, r.removed_chars) for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by_id = {i: (t, n) for i, t, n in got}
    assert by_id[1] == (rows[0][1], 0) and by_id[10] == (whole, 0) and by_id[12][1] == 0
    for i in range(2, 6):
        assert 250 <= by_id[i][1] <= 330 and not any(passage[k : k + 60] in by_id[i][0] for k in range(240))
    assert by_id[11][1] > 200
    assert sorted(t == whole and n == 0 for i, t, n in got if i is None) == [True, True]


def test_word_spans_match_the_pattern():
    import pyarrow as pa

    texts = ["", " a  b\n", "x", None, "é ü\x0bz", "a\x1fb \x85c"]
    for _, data, offsets in textbytes.text_blocks(pa.array(texts), max_bytes=4):
        starts, ends, at = textbytes.word_spans(data, offsets)
        for i in range(len(offsets) - 1):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            assert [data[a:b].tobytes() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] == re.findall(rb"[^\x20\x09-\x0D]+", raw)
