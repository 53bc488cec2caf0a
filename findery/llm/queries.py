"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import bpe, decontaminate, language, licenses, outliers, pii, prefixtrie, quality_net, reshard, simhash, tokenfile, toxicity, vectorcodes
from findery.llm.common import scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, out)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumns({k: F.array_join(k, ",") for k in ("base_labels", "labels")})


def _remainder(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_net.QualityModel:
    """The classifier of op8 and of the pipeline: learnt from rows outside the held-out fold only."""
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality_net.train(docs, labels)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality_net.classify(docs, quality_model(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, _remainder(4) != 2))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_table(spark, sf_dir, "documents")).drop("d2")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, pii.KINDS)
    digest = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, digest, pii.listed(F.concat("base", "added")).alias("spans"))


OLD_SHARDS, NEW_SHARDS = 20, 24


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = reshard.reshard(reshard.lay_out(docs, old, OLD_SHARDS, scratch(spark, "shards")), NEW_SHARDS)
    return found.rows().select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(_table(spark, sf_dir, "embeddings"))
    rows = vectorcodes.with_label_errors(found.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.books.sha256()).alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.classify(docs, toxicity.train(docs, labels))
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefixtrie.rebuilt(prefixtrie.ordered(_table(spark, sf_dir, "conversations")))
    turns = written(turns, scratch(spark, "rebuilt"))
    nodes = prefixtrie.prefix_trie(turns, convs)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4 alone, which SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which SQL can express."""
    return op7_licenses(spark, sf_dir).drop("labels", "score")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10, which SQL can express."""
    found = outliers.statistics(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", outliers.base_failed().alias("base_failed"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_tokenfile, op4_pii, op5_reshard, op6_decontaminate, op7_licenses, op8_quality, op9_language, op10_quality_rules, op11_vectorcodes, op12_toxicity, op13_prefixtrie, pii_base_counts, license_phrases, quality_counts)}

def _vectorcodes_sql() -> str:
    """Four rounds of weighted means over the distinct parts, one table expression a round; vectors of 64 dimensions."""
    parts = """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
),
each AS MATERIALIZED (SELECT row, vec_id, label, p, v[16 * p + 1:16 * p + 16] AS part FROM kept, range(4) t(p)),
uniq AS MATERIALIZED (SELECT p, part, part::DOUBLE[] AS x, count(*) AS n FROM each GROUP BY ALL),
b0 AS MATERIALIZED (SELECT p, code, v[16 * p + 1:16 * p + 16] AS entry FROM (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM kept QUALIFY code < 256), range(4) t(p))"""
    near = """,
a{k} AS MATERIALIZED (
    SELECT p, part, any_value(n) AS n, min(struct_pack(d := d, code := code)) AS best FROM (
        SELECT u.p, part, n, code, list_inner_product(x, x) - 2 * list_inner_product(x, entry::DOUBLE[]) + list_inner_product(entry::DOUBLE[], entry::DOUBLE[]) AS d
        FROM uniq u JOIN b{k} b ON u.p = b.p)
    GROUP BY ALL
)"""
    moved = """,
b{next} AS MATERIALIZED (
    SELECT b.p, b.code, coalesce(m.entry, b.entry) AS entry FROM b{k} b LEFT JOIN (
        SELECT p, code, list(CAST(floor(s / w) AS BIGINT) ORDER BY i) AS entry
        FROM (SELECT p, best.code AS code, i, sum(n * part[i])::DOUBLE AS s, sum(n) AS w FROM a{k}, range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL
    ) m ON b.p = m.p AND b.code = m.code
)"""
    rounds = "".join(near.format(k=k) + moved.format(k=k, next=k + 1) for k in range(4)) + near.format(k=4)
    return (
        parts
        + rounds
        + """,
coded AS (SELECT row, vec_id, label, string_agg(lpad(lower(to_hex(best.code)), 2, '0'), '' ORDER BY e.p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM each e JOIN a4 ON e.p = a4.p AND e.part = a4.part GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, code)) FROM b4) AS codebooks_sha256
FROM coded
"""
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_vectorcodes": _vectorcodes_sql(),
    "op13_prefixtrie": """
WITH tab AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS t
    FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))
),
turns AS MATERIALIZED (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS MATERIALIZED (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), tab
),
r AS (
    SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= h
    UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h
),
d AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM r),
p AS MATERIALIZED (
    SELECT conv_id, depth, length(text) AS chars, sha256(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth))::VARCHAR) AS node FROM d
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
n AS MATERIALIZED (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY ALL),
edges AS MATERIALIZED (SELECT DISTINCT node, parent FROM (SELECT node, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p) WHERE parent IS NOT NULL),
kids AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY 1),
stat AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS own FROM n LEFT JOIN kids USING (node)),
sub AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM sub JOIN stat USING (node) GROUP BY 1),
ends AS (
    SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, node FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY 1
)
SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM stat s JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN edges e ON e.node = s.node LEFT JOIN stat u ON u.node = e.parent
""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS size, list_slice(w, k, k + least(10, len(w)) - 1) AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, size, k, list_slice(w, k, k + size - 1) AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
          FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, item, k, dw.size FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "pii_base_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
    SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
        list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda h: regexp_replace(h, '[^0-9]', '', 'g')) AS cards, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phones
    FROM t
)
SELECT doc_id, n_email, len(list_filter(ips, lambda h: list_bool_and(list_transform(string_split(h, '.'), lambda p: p::HUGEINT <= 255)))) AS n_ip,
    len(list_filter(cards, lambda d: len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN d[len(d) - k + 1]::INT ELSE (2 * d[len(d) - k + 1]::INT) - CASE WHEN d[len(d) - k + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
    len(list_filter(phones, lambda h: len(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone
FROM m
""",
    "license_phrases": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, k - 1 AS k, CASE WHEN w[k:k + 1] = ['cc', 'by'] THEN 'cc-by' WHEN w[k:k + 2] = ['general', 'public', 'license'] THEN 'gpl' WHEN w[k:k + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
f AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f USING (doc_id)
""",
    "quality_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, k, w[k:k + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
again AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM wins JOIN again USING (doc_id, win)) GROUP BY 1),
lines AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS n FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS x FROM d))
SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, lines.n::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
""",
}
