"""Queries of the operators of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, grammar_shards, hard_negatives, hilbert_ann, lattice_lm, license_scan, mixing, ngram_join, sharding, spelling_forms, toxicity, url_filter, warc

SHARDS = [f"shard-{k:02d}" for k in range(16)]

#: Id that ends a document in token files.
END_ID = 2

# Fixed values: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest_columns(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2, spans=False))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(warc.with_record_types(table(spark, sf_dir, "pages")))
    return warc.resolved(warc.read_archives(warc.read_folder(spark, path)))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (toxicity.fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_windows", "worst_start")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    # This vocabulary drops white space before it looks for tokens.
    listed = grammar_shards.write_shards(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), END_ID, apart=True)
    return grammar_shards.read_shards(listed).withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms.spelling_forms(spelling_forms.counted_words(table(spark, sf_dir, "documents")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# A phrase is found by its words joined; a near run from the two words of its window that are rarest in the documents.
OP1_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + 9], ' ') AS win FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS k FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, k, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
need AS (SELECT win, n, x, count(*) AS need FROM (SELECT win, n, unnest(string_split(win, ' ')) AS x FROM (SELECT DISTINCT win, n FROM bw)) GROUP BY ALL),
pos AS (SELECT * FROM (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS x FROM w) WHERE x IN (SELECT x FROM need)),
freq AS (SELECT x, count(*) AS f FROM pos GROUP BY x),
rare AS (SELECT win, n, list(x ORDER BY coalesce(f, 0), x) AS xs FROM need LEFT JOIN freq USING (x) GROUP BY ALL),
around AS (SELECT DISTINCT win, n, a.doc_id, a.p FROM rare JOIN pos a ON a.x = xs[1] JOIN pos c ON c.doc_id = a.doc_id AND c.x = coalesce(xs[2], xs[1]) AND abs(c.p - a.p) < n + 2),
cand AS (SELECT DISTINCT r.win, r.n, s.doc_id, s.p FROM around r JOIN pos s ON s.doc_id = r.doc_id AND s.p > r.p - r.n - 2 AND s.p <= r.p JOIN need ON need.win = r.win AND need.n = r.n AND need.x = s.x),
held AS (SELECT cand.win, cand.n, cand.doc_id, cand.p, s.x, count(*) AS c FROM cand JOIN pos s ON s.doc_id = cand.doc_id AND s.p >= cand.p AND s.p < cand.p + cand.n + 2 GROUP BY ALL),
runs AS (SELECT held.win, held.n, doc_id, p FROM held JOIN need ON need.win = held.win AND need.n = held.n AND need.x = held.x AND c >= need GROUP BY ALL HAVING count(*) = len(list_distinct(string_split(held.win, ' ')))),
near AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM runs GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""



def op3_sql() -> str:
    """The lookup table is one hexadecimal digit for each slot."""
    table = "".join(f"{k:x}" for k in sharding.lookup_table(SHARDS))
    return f"""WITH s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(('0x' || substr('{table}', slot + 1, 1))::INT::VARCHAR, 2, '0') AS shard FROM s"""


# All pairs of documents that share an n-gram, then what links reach.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

OP4_SQL = r"""
WITH s AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::DOUBLE AS w, z * 2.0::DOUBLE AS cap FROM t),
l AS (SELECT *, ((sum(z) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
g AS (SELECT source, z, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target FROM l, f),
r AS (SELECT s.*, z, target, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate, ('0x' || substr(md5(concat_ws(chr(31), '0', coalesce(doc_id::VARCHAR, chr(0)), coalesce(s.source, chr(0)), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM r)
SELECT doc_id, size, z AS source_size, target, size * copies AS taken, source, copies FROM c
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d),
x AS (SELECT *, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in [0, 1, 2, 3, 4]] AS v FROM f),
bits AS (SELECT *, array_to_string([lpad(to_binary(e), 32, '0') for e in v], '') AS b FROM x)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT), 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(struct_pack(rule := h || q, verdict := verdict), length(h) + length(q)) AS r FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


# Every anchor with every row of its own label, then with every row of another.
OP11_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.s AS ps, s.b AS nb, s.s AS ns FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, b AS positive_id, (row_number() OVER (PARTITION BY a, b ORDER BY ns DESC, nb))::INT AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ns DESC, nb) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_sharding, op4_mixing, op5_warc, op6_hilbert_ann, op7_toxicity, op8_lattice_lm, op9_url_filter, op10_ngram_join, op11_hard_negatives, op12_grammar_shards, op13_spelling_forms)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_mixing": OP4_SQL, "op2_license_scan": license_scan.oracle_sql(), "op3_sharding": op3_sql(), "op10_ngram_join": OP10_SQL, "op5_warc": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op9_url_filter": OP9_SQL}
