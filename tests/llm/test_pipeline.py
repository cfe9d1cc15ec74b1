"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelrisk.llm import mixing, stages
from panelrisk.sources.tables import table
from test_dedup import brute_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def grams(texts, n=51):
    seen = {}
    for d, t in texts:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    return seen


def test_language_stage_keeps_prose_and_drops_the_rest(spark, docs):
    junk = spark.createDataFrame([(10**6, "12 34 !!", None, "s", 8), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "", "fr", None, 0)], docs.schema)
    out = stages.language_id(spark, docs.unionByName(junk), SF)
    assert out.columns == docs.columns
    got, was = {r.doc_id: r.lang for r in out.collect()}, {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(was)  # the tables hold prose only
    assert sum(got[d] == was[d] for d in was) >= 0.98 * len(was)


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    twice = docs.unionByName(docs.limit(3))
    out = stages.near_dedup(spark, twice, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(d for d, _, c in brute_components(rows) if c == d)
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == docs.columns


def test_substring_stage_leaves_no_passage_twice(spark, docs):
    out = stages.substring_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
    assert set(before) == set(after)
    shared = set().union(*[x for x in grams(before.items(), 16).values() if len(x) > 1] or [set()])
    assert not [x for x in grams(after.items()).values() if len(x) > 1]
    own = lambda t: len(set(w := [tuple(WORD.findall(t)[i : i + 16]) for i in range(len(WORD.findall(t)) - 15)])) == len(w)
    assert all(before[d] == after[d] for d in before if d not in shared and own(before[d]))
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_mix_stage_emits_what_the_mix_takes(spark, docs):
    out = stages.mix(spark, docs, SF)
    assert out.columns == docs.columns
    took = {}
    for r in out.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + len(WORD.findall(r.text))
    want = {r.doc_id: r.taken for r in mixing.place_documents(docs, ["doc_id"]).collect() if r.taken}
    assert took == want


def test_run_is_the_chain_of_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix", "pack"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in table(spark, SF, "documents").collect()} and ids
    assert out.where("offset < 0 OR length < 1").count() == 0


def test_stages_of_an_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


NAMES = ["score", "lang_pred", "ambiguous", "_kept", "kept", "id", "mark", "removed_chars", "removed_spans", "shard", "shuffle_key", "_slice", "copies", "size", "c0", "n", "row"]


def test_columns_of_any_name_pass_through(spark, docs):
    rows = docs.limit(60)
    wide = rows.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}-{r.doc_id}" for c in NAMES), name
    plain, packed = (corpus_pipeline.STAGES[-1][1](spark, d, SF) for d in (rows, wide))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, packed.collect()))


def test_near_dedup_decides_by_row(spark, docs):
    """Id 7 has a text of its own and one of document 3's group: only the latter goes. So does a row without an id."""
    long = "one two three four five six seven eight nine ten"
    rows = [(3, long), (7, long), (7, "eleven twelve thirteen fourteen fifteen sixteen"), (None, long), (None, "alone with words of its own here"), (None, None), (9, None), (9, None), (9, ""), (3, long)]
    frame = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], docs.schema)
    out = [(r.doc_id, r.text) for r in stages.near_dedup(spark, frame, SF).collect()]
    want = [(3, long), (7, rows[2][1]), (None, rows[4][1]), (None, None), (9, None), (9, "")]
    assert sorted(map(str, out)) == sorted(map(str, want))


def test_stages_with_nulls_and_shared_ids(spark, docs):
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(1, passage, None, None, None), (None, passage, "en", "s", 3), (1, passage + " end", "en", None, 1), (2, "start " + passage, "en", "s", 1), (4, None, None, None, None), (4, "", "fr", "s", 0)]
    frame = spark.createDataFrame(rows, docs.schema)
    cut = {(r.doc_id, r.text) for r in stages.substring_dedup(spark, frame, SF).collect()}
    assert (None, passage) in cut and (4, None) in cut and (4, "") in cut and not any(d == 2 and passage in t for d, t in cut)
    mixed = stages.mix(spark, frame, SF).collect()
    assert {r.doc_id for r in mixed} <= {1, 2, None} and all(r.text for r in mixed)
    packed = stages.pack(spark, frame, SF)
    assert packed.where("start = 0").count() == len(rows)
