"""Thin queries over the operators of this subpackage, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm import align, chunks, extract, fingerprints, langid, license_texts, licenses, minhash, mixing, packing, quality, rabitq, spelling, urlfilter
from panelrisk.session import bound_batches
from panelrisk.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@register
def op1_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.cosine_links(table(spark, sf_dir, "embeddings"))


@register
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op6_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT ee.y, r.c FROM r JOIN ee ON ee.x = r.doc_id WHERE r.c < ee.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@register
def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "removed_chars", F.to_json("removed_spans").alias("removed_spans"))


def vocabulary() -> str:
    """Path of the public tokenizer file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.place_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    # each copy's shard and words
    shards = F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["shard"].cast("string"), c["words"].cast("string"))), ",")
    return out.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


ORACLE["op5_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents
), s0 AS (
  SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source
), s1 AS (
  SELECT *, 2 * source_size AS cap, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM s0
), s2 AS (
  SELECT *, sum(cap) OVER o - cap AS fixed, sum(w) OVER () - sum(w) OVER o + w AS open, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total
  FROM s1 WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, rank)
), s3 AS (SELECT *, (total - fixed) / CAST(open AS DOUBLE) AS lv FROM s2),
s4 AS (SELECT *, (SELECT arg_min(lv, [CAST(cap AS DOUBLE) / w, CAST(rank AS DOUBLE)]) FROM s3 WHERE CAST(cap AS DOUBLE) / w >= lv) AS level FROM s3),
s AS (
  SELECT source, rank, docs, source_size, least(CAST(cap AS DOUBLE), w * level) AS target, CAST(floor(least(CAST(cap AS DOUBLE), w * level) + 0.5) AS BIGINT) AS quota,
    (docs + 255) // 256 AS blocks FROM s4
), p AS (
  SELECT d.doc_id, d.size, d.place, s.* EXCLUDE (source), CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS copies,
    sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
    (CAST('0x' || substr(d.place, 1, 8) AS BIGINT) * s.blocks) >> 32 AS block
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), t AS (SELECT *, CAST(greatest(0, least(size, quota - copies * source_size - before)) AS BIGINT) AS last FROM p),
b AS (SELECT rank, block, any_value(copies) + CASE WHEN sum(last) > 0 THEN 1 ELSE 0 END AS drawn FROM t GROUP BY ALL HAVING sum(size) > 0),
depth AS (SELECT greatest(4, ceil(log2(greatest(1, sum(target) / 67108864)))) AS levels FROM s),
tree AS (
  SELECT rank, block, unnest(range(1, drawn + 1)) AS copy, CAST(0 AS BIGINT) AS node, 0 AS level FROM b
  UNION ALL
  SELECT rank, block, copy, 2 * node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY key, rank, copy, block) <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END, level + 1
  FROM (SELECT *, md5('mix-1/' || level || '|' || rank || '|' || copy || '|' || block) AS key FROM tree, depth WHERE level < levels)
), leaf AS (SELECT rank, block, copy, node FROM tree, depth WHERE level = levels),
given AS (
  SELECT t.rank, t.block, t.doc_id, t.place, t.before, string_agg(leaf.node || ':' || CASE WHEN leaf.copy <= t.copies THEN t.size ELSE t.last END, ',' ORDER BY leaf.copy) AS shards
  FROM t JOIN leaf ON leaf.rank = t.rank AND leaf.block = t.block AND CASE WHEN leaf.copy <= t.copies THEN t.size ELSE t.last END > 0 GROUP BY ALL
)
SELECT t.doc_id, t.size, source_size, target, CAST(t.copies * t.size + t.last AS BIGINT) AS taken, coalesce(shards, '') AS shards
FROM t LEFT JOIN given g ON g.rank = t.rank AND g.before = t.before AND g.doc_id IS NOT DISTINCT FROM t.doc_id AND t.size > 0
"""


@register
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def _sketch_sql(text: str) -> str:
    """DuckDB: the sorted distinct shingle hashes of a text expression, cut to the sketch size."""
    words = f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""(SELECT list_sort(list_distinct(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16))
      WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 16)] ELSE CAST([] AS VARCHAR[]) END))[1:128] FROM (SELECT {words} AS w))"""


def _near_sql(a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN len(u) = 0 THEN 1.0 ELSE CAST(len(list_filter(list_intersect({a}, {b}), lambda h: h <= u[len(u)])) AS DOUBLE) / len(u) END
      FROM (SELECT list_sort(list_distinct(list_concat({a}, {b})))[1:128] AS u))"""


ORACLE["op4_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, {_sketch_sql("text")} AS fp FROM d),
n AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nt, coalesce(lead(fp) OVER o, first_value(fp) OVER o) AS nfp
  FROM f WINDOW o AS (ORDER BY doc_id, text)
), e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nt, 1, length(text) // 2) AS edited FROM n),
g AS (SELECT *, {_sketch_sql("edited")} AS efp FROM e)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(fp, '') AS fingerprint,
  array_to_string(efp, '') AS edited_fingerprint, {_near_sql("fp", "efp")} AS near_edited, {_near_sql("fp", "nfp")} AS near_next
FROM g
"""


@register
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spelled = "' ' || x || ' '"
    for a, b in license_texts.SPELLINGS.items():
        spelled = f"replace({spelled}, ' {a} ', ' {b} ')"
    texts = [(k, f"{title}\n\n{text}") for k, text in license_texts.TEXTS.items() for title in ["", *license_texts.TITLES.get(k, [])]]
    notices = [(k, form.format(name)) for k, names in license_texts.NAMES.items() for form in license_texts.NOTICES for name in names]
    values = ", ".join(f"({quote(kind)}, {quote(k)}, {quote(t)})" for kind, rows in (("text", texts), ("notice", notices)) for k, t in rows)
    return f"""
WITH raw AS (SELECT 'doc' AS kind, CAST(NULL AS VARCHAR) AS spdx, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT kind, spdx, 0, NULL, t FROM (VALUES {values}) v(kind, spdx, t)),
n AS (SELECT * EXCLUDE (text), list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10)), {quote(licenses.COPYRIGHT_LINE)}, chr(10), 'g'),
    {quote(licenses.NOT_TEXT)}, ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM raw),
g AS (SELECT * EXCLUDE (lines), sha256(trim((SELECT {spelled} FROM (SELECT array_to_string(lines, ' ') AS x)))) AS digest, lines FROM n),
known AS (SELECT kind, digest, min(spdx) AS spdx FROM g WHERE kind <> 'doc' GROUP BY ALL),
l AS (SELECT r, x FROM (SELECT r, unnest(lines) AS x FROM g WHERE kind = 'doc')),
h AS (SELECT r, k.spdx FROM (SELECT r, sha256(trim({spelled})) AS d FROM l) JOIN known k ON k.kind = 'notice' AND k.digest = d),
hs AS (SELECT r, array_to_string(list_sort(list_distinct(list(spdx))), ',') AS notices, count(*) AS n FROM h GROUP BY r)
SELECT g.doc_id, g.digest, coalesce(t.spdx, '') AS license, coalesce(hs.notices, '') AS notices, CAST(coalesce(hs.n, 0) AS BIGINT) AS n_notices
FROM g LEFT JOIN known t ON t.kind = 'text' AND t.digest = g.digest LEFT JOIN hs ON hs.r = g.r WHERE g.kind = 'doc'
"""


ORACLE["op2_licenses"] = _license_sql()


@register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), ["doc_id"])


@register
def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@register
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.alignment(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


#: fixed values of the contract: verdict, host, beginning of the path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@register
def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), listing, ["page_id"])


ORACLE["op12_urls"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, b) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
n AS (SELECT row_number() OVER () AS r, * FROM p),
hit AS (SELECT r, arg_max(h || b, length(h || b)) AS rule, arg_max(verdict, length(h || b)) AS verdict FROM n JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(hit.verdict, 'allow') AS verdict FROM n LEFT JOIN hit USING (r)
"""


@register
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), drop_every=31)
    return spelling.variant_forms(words)


ORACLE["op13_spelling"] = """
WITH RECURSIVE step(c, v, k) AS (
  SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT c, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM step WHERE k < 8
), tab AS (SELECT list(v ORDER BY c) AS t FROM step WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, hex(CAST(doc_id AS VARCHAR) || ':' || run) AS x, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
  lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less
), o AS (SELECT word, count(*) AS n_near, arg_min(near, row(-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN o USING (word)),
chain(word, root, next) AS (
  SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
