"""Cross-tokenizer alignment against the tokenizer libraries and a literal walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelrisk.llm import align, tokens
from panelrisk.llm.textbytes import text_blocks
from panelrisk.sources.tables import table
from tests.conftest import SF_SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
_SP = sentencepiece.SentencePieceProcessor(model_file=B)
_BPE = Tokenizer.from_file(A)
_BPE.encode_special_tokens = True
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

TEXTS = [
    None, "", " ", "   ", "a", "Hello  world", "x▁y", "▁", "<|endoftext|> a <s></s> <0x0A>", "tab\tnew\nline\r\n", "don't we'll", "日本語のテキスト", "é è ü ß ×÷", "a\0b",
    "😀 emoji 👩‍👩‍👧", " lead", "trail ", "word " * 300, "nospace" * 500, "\n\n\n", "1234567890 3.14", "the the the", " nbsp em", "é combining", "﻿bom",
]


def walk(text):
    """(a ids, b ids, groups, links) by single bytes."""
    none = [], [], [], []
    if not text:
        return none
    want = (" " + text).encode()
    a, b = _BPE.encode(" " + text, add_special_tokens=False).ids, _SP.encode(text)
    spell_a = [bytes(_BYTE[c] for c in _BPE.id_to_token(i)) for i in a]
    spell_b = [bytes([int(_SP.id_to_piece(i)[1:-1], 16)]) if _SP.is_byte(i) else _SP.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spell_a) != want or b"".join(spell_b) != want:
        return none
    of_a = [k for k, s in enumerate(spell_a) for _ in s]
    of_b = [k for k, s in enumerate(spell_b) for _ in s]
    links = sorted(set(zip(of_a, of_b)))
    groups, ga, gb = [], [], []
    for at in range(len(want)):
        if not ga or ga[-1] != of_a[at]:
            ga.append(of_a[at])
        if not gb or gb[-1] != of_b[at]:
            gb.append(of_b[at])
        if at + 1 == len(want) or (of_a[at + 1] != of_a[at] and of_b[at + 1] != of_b[at]):
            groups.append(([a[k] for k in ga], [b[k] for k in gb]))
            ga, gb = [], []
    return a, b, groups, [(a[x], b[y]) for x, y in links]


def brute(rows):
    found = [(d, *walk(t)) for d, t in rows]
    held = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, total = sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)
        out.append((d, len(a), len(b), len(groups), len(links), best, total, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, align.alignment(docs, A, B).collect()), key=str) == brute(rows)


def test_hard_texts(spark):
    check(spark, [*enumerate(TEXTS), (3, "a"), (None, "the end"), (None, None), *[(100 + i, "same text of a group") for i in range(40)]])


def test_many_blocks(spark):
    rng = random.Random(8)
    pool = ["the", "of", "Haus", "élan", "naïve", "x1", "  ", "\n", "résumé", "ing", "tokenization", "日本"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", "s", "ed", ","]) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, align.alignment(docs, A, B, block=300).collect()), key=str) == brute(rows)


def test_given_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = sorted(map(tuple, align.alignment(docs, A, B).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_blocks_are_cut_and_the_memory_starts_anew(monkeypatch):
    """The same figures whatever the cuts, without Spark."""
    texts = [t for t in TEXTS if t] * 3

    def digests(size, pieces):
        monkeypatch.setattr(tokens, "CACHE_PIECES", pieces)
        out = []
        for _, data, offsets in text_blocks(pa.array(texts), size):
            out += align._digests(align.align_rows(data, offsets, A, B), len(offsets) - 1)
        return out

    assert digests(1 << 19, 1 << 18) == digests(50, 5) == [x[-1] for x in sorted(brute([(i, t) for i, t in enumerate(texts)]), key=lambda r: r[0])]


def test_groups_spell_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in align.token_groups(docs, A, B).orderBy("doc_id", "group").collect():
        got.setdefault(r.doc_id, []).append((list(r.a), list(r.b)))
        raw = (" " + TEXTS[r.doc_id]).encode()[r.start : r.stop]
        assert b"".join(bytes(_BYTE[c] for c in _BPE.id_to_token(i)) for i in r.a) == raw
    assert got == {i: [(list(x), list(y)) for x, y in walk(t)[2]] for i, t in enumerate(TEXTS) if walk(t)[2]}


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "the end", 5, "x")], "doc_id int, text string, block int, pairs string")
    assert align.alignment(docs.where("false"), A, B).count() == 0
    assert align.alignment(docs, A, B).select(F.max("n_links")).first()[0] == len(walk("the end")[3])
