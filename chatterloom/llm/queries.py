"""Registered queries of the training-data operators, with their DuckDB check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterloom.llm import chat, chunks, decontaminate as decon, jaccard, language, mixture, order, quality, repair, shards, simhash, trie, warc
from chatterloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
found AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, found.size, i, item FROM found JOIN grams ON found.gram = grams.gram AND found.size = grams.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON w.doc_id = words.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""


@query(DECONTAMINATE_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
node AS (SELECT h, min(doc_id) AS id, count(*) AS copies, min(n) AS n FROM sets GROUP BY h),
own AS (SELECT s.doc_id AS id, g FROM s JOIN node ON s.doc_id = node.id),
inter AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM own a JOIN own b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
link AS (
  SELECT a, b, nb.copies AS weight FROM inter JOIN node na ON na.id = a JOIN node nb ON nb.id = b
  WHERE k * 5 >= 4 * (na.n + nb.n - k)),
reach AS (SELECT id, id AS seen FROM node UNION SELECT reach.id, b FROM reach JOIN link ON link.a = reach.seen),
class AS (SELECT id, min(seen) AS class_id FROM reach GROUP BY id),
links AS (SELECT a AS id, sum(weight)::BIGINT AS links FROM link GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(node.id, w.doc_id) AS copy_id,
  coalesce(coalesce(links, 0) + copies - 1, 0)::BIGINT AS n_links
FROM w LEFT JOIN sets ON w.doc_id = sets.doc_id LEFT JOIN node ON node.h = sets.h
LEFT JOIN class ON class.id = node.id LEFT JOIN links ON links.id = node.id
"""


@query(JACCARD_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, 24 - 1 + length(regexp_replace(role, '([<\[])(\\*)(\|\w+\|>|/?s>|/?SYS>>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\|\w+\|>|/?s>|/?SYS>>|/?INST\])', '\1\\\2\3', 'g')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

PROBE = """
SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
AS probe(conv_id, turn, role, text)
"""


@query(CHAT_SQL)
def op1_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number is read back from the examples; ``formatted_chars`` counts all of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    made = chat.prefix_examples(turns)
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    heard = F.when(F.col("last"), chat.read_turns(F.col("text")))
    back = made.select("conv_id", "position", F.char_length("text").alias("size"), heard.alias("heard"),
                       F.when(F.col("trainable"), chat.trained_text(made)).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("heard", turn), ""), 256)
    per_conv = back.select(
        "conv_id", "size", F.size("heard").alias("n"), F.when(F.col("heard").isNotNull(), digest).alias("digest"),
        F.when(F.col("loss").isNotNull(), F.struct("position", "loss")).alias("loss"),
    ).groupBy("conv_id").agg(
        F.max("n").cast("bigint").alias("n_turns"), F.max("digest").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("size").alias("formatted_chars"),
    )
    return per_conv.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, 'tier-' || length(bin(doc_id % 64)) AS source, coalesce((length(text) + 3) // 4, 0)::BIGINT AS tokens FROM documents),
src AS (SELECT source, sum(tokens)::BIGINT AS t FROM d GROUP BY source),
p AS (SELECT source, t, t::DOUBLE / (SELECT sum(t) FROM src)::DOUBLE AS p FROM src),
natural_h AS (SELECT -sum(p * ln(p)) / ln(count(*)) AS h, count(*) AS n FROM p),
bis AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2))
         >= 0.95 * ln(count(*)) FROM p) AS up
    FROM bis WHERE step < 60)),
rep AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT pow(min(p), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) > 4 FROM p) AS up
    FROM rep WHERE step < 60)),
expo AS (
  SELECT greatest(CASE WHEN (SELECT h >= 0.95 FROM natural_h) THEN 1.0 ELSE (SELECT (lo + hi) / 2 FROM bis WHERE step = 60) END,
    (SELECT (lo + hi) / 2 FROM rep WHERE step = 60)) AS a),
plan AS (
  SELECT source, t, ceil(t / 1048576)::BIGINT AS blocks, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p) * (SELECT sum(t) FROM src))::BIGINT AS b
  FROM p, expo),
dealt AS (
  SELECT doc_id, d.source, tokens, t, b // t AS whole, b % t AS part,
    ('0x' || substr(md5('mix:block:' || doc_id), 1, 15))::BIGINT % blocks AS block
  FROM d JOIN plan ON d.source = plan.source),
many AS (
  SELECT *, ('0x' || substr(md5('mix:order:' || epoch || ':' || block), 1, 15))::BIGINT AS bo,
    ('0x' || substr(md5('mix:' || epoch || ':' || doc_id), 1, 15))::BIGINT AS o
  FROM (SELECT *, unnest(range(0, whole + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS epoch FROM dealt)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY bo, block, o, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM many)
SELECT doc_id, source, tokens, epoch, (upto - tokens)::BIGINT AS start, round((SELECT a FROM expo), 9) AS exponent
FROM run WHERE upto <= CASE WHEN epoch < whole THEN t ELSE part END
"""


@query(MIX_SQL)
def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in six tiers, each about twice the one before: the sources of the given table are of one size, and
    a mixture of equal sources is the table itself. Half the documents are in the last tier; of that a part
    goes in, and the small tiers go in several times. Texts are repeated and placed with their rows; ``tokens`` is read back
    from the text of the output."""
    tier = F.concat(F.lit("tier-"), F.length(F.bin(F.col("doc_id") % 64)))
    docs = table(spark, sf_dir, "documents").select("doc_id", tier.alias("source"), "text")
    mixed = mixture.mix(docs, entropy=0.95, max_epochs=4.0, with_exponent=True)
    return mixed.select(
        "doc_id", "source", mixture.estimated_tokens("text").alias("tokens"), "epoch", "start", F.round("exponent", 9).alias("exponent")
    )


SHARDS_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
b AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
    string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g')), ' ') AS bytes FROM documents),
d AS (
  SELECT doc_id, source, size,
    xor(4294967295, CASE WHEN size = 1 THEN 4294967295 ELSE list_reduce(bytes, lambda c, x: xor(t[xor(c::BIGINT, ('0x' || x)::BIGINT) % 256 + 1], c::BIGINT // 256)::VARCHAR, '4294967295')::BIGINT END) AS crc
  FROM b, crc),
h AS (SELECT *, ('0x' || substr(md5('shards:' || doc_id || ':' || crc), 1, 15))::BIGINT AS h FROM d),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, source, h, doc_id, crc) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (pos * 16 // n)::INTEGER AS shard,
  (pos - ((pos * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


@query(SHARDS_SQL)
def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.read_archive(spark, folder))


@query()
def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ordered_rows(table(spark, sf_dir, "documents"), shared_folder(spark, "order"))


@query()
def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives are the documents that ``labels`` calls good, outside the held-out quarter; its other labels go unused."""
    aside = quality.held_out("doc_id", 4, 2)
    features = quality.learned_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), skip=aside)
    out = quality.scored(features, quality.fit(features)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", aside.alias("held_out"), "score", "predicted")


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), quality.held_out("doc_id", 3, 1)
    model = language.fit(docs.filter(~aside))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", aside.alias("held_out"), "lang_pred", "score")


@query()
def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with planted faults; the damage of a row follows from its conversation and turn."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    how = F.crc32(F.concat(plain["conv_id"], F.lit(":"), plain["turn"])) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", plain["role"].alias("role"), plain["text"].alias("text"), how.alias("how"))
    return rows.filter("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes
  FROM conversations),
h AS (SELECT r.*, xor(4294967295, list_reduce(bytes, lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256), 4294967295::BIGINT)) % 20 AS how FROM r, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS c,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
f AS (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair,
    CASE WHEN said = '' THEN 'b' WHEN c > 1 THEN 'd' WHEN right(said, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault FROM o),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
ins(q, p, put, ic) AS (VALUES (0, 0, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 1, '', 0), (1, 2, 'I', 3), (1, 3, 'II', 6),
  (2, 2, '', 0), (2, 3, 'I', 3), (3, 3, '', 0), (3, 2, 'I', 3)),
edit(p, x, q2, op, ec) AS (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0),
  (0, '*', 2, 'R', 3), (1, '*', 2, 'R', 3), (3, '*', 2, 'R', 3), (2, '*', 3, 'R', 3),
  (0, '*', 0, 'D', 4), (1, '*', 1, 'D', 4), (2, '*', 2, 'D', 4), (3, '*', 3, 'D', 4)),
walk(conv_id, i, q, w) AS (
  SELECT conv_id, 0::BIGINT, 0, '000000' FROM facts
  UNION ALL
  SELECT walk.conv_id, i + 1, q2, min(
    lpad((left(w, 6)::INT + ic + ec + CASE WHEN op <> 'D' AND fault = 't' THEN 3 ELSE 0 END)::VARCHAR, 6, '0') || substr(w, 7) || put || op)
  FROM walk JOIN f ON f.conv_id = walk.conv_id AND f.n = i + 1 JOIN ins ON ins.q = walk.q
  JOIN edit ON edit.p = ins.p AND edit.x IN (f.x, '*') AND (op = 'D' OR fault IN ('k', 't'))
  GROUP BY walk.conv_id, i + 1, q2),
best AS (
  SELECT walk.conv_id, min(lpad((left(w, 6)::INT + ic)::VARCHAR, 6, '0') || substr(w, 7) || put) AS w
  FROM walk JOIN facts ON facts.conv_id = walk.conv_id AND i = rows JOIN ins ON ins.q = walk.q AND ins.p IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, unnest(range(7, length(w) + 1)) AS j, w FROM best),
placed AS (
  SELECT conv_id, j, substr(w, j, 1) AS e, count(*) FILTER (substr(w, j, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS n,
    count(*) FILTER (substr(w, j, 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS p FROM letters),
kept AS (
  SELECT placed.conv_id, j, e, p, CASE WHEN e = 'I' THEN '' ELSE text END AS text, role,
    max(CASE WHEN p = 1 AND e = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS s
  FROM placed LEFT JOIN f ON f.conv_id = placed.conv_id AND f.n = placed.n WHERE e <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS all_lines
  FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(w, 6)::BIGINT, 0) AS cost,
  coalesce(substr(w, 7), '') AS audit, sha256(coalesce(all_lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts ON facts.conv_id = a.conv_id
LEFT JOIN best ON best.conv_id = a.conv_id LEFT JOIN lines ON lines.conv_id = a.conv_id
"""


@query(REPAIR_SQL)
def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = repair.repaired(damaged(turns))
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(made, every["_id"].eqNullSafe(made["conv_id"]), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that begin with up to three turns of the first of their twenty, as ``conv_id, turn, role, text``."""
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    said = said.withColumn("turn", F.row_number().over(in_order))
    heads = said.filter("turn <= 3").select(F.col("conv_id").alias("donor"), "turn", "role", "text")
    shared = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 4, F.lit(0))
    talks = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("donor"), shared.alias("h"))
    taken = talks.join(heads, "donor").filter("turn <= h")
    begun = talks.join(heads.groupBy("donor").agg(F.count(F.lit(1)).alias("has")), "donor", "left")
    begun = begun.select(F.col("conv_id").alias("_id"), "h", F.least("h", F.coalesce("has", F.lit(0))).alias("got"))
    own = said.join(begun, F.col("conv_id").eqNullSafe(F.col("_id"))).filter("turn > h")
    return taken.select("conv_id", "turn", "role", "text").unionByName(
        own.select("conv_id", (F.col("turn") - F.col("h") + F.col("got")).alias("turn"), "role", "text")
    )


TRIE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations),
own AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY n) AS turns FROM said GROUP BY conv_id),
word AS (
  SELECT DISTINCT md5(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM said),
h AS (
  SELECT own.*, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256), 4294967295::BIGINT)) % 4 AS h FROM own, crc),
talk AS (
  SELECT h.conv_id, list_concat(coalesce(donor.turns[:h], []), h.turns[h + 1:]) AS turns
  FROM h LEFT JOIN own donor ON donor.conv_id = h.conv_id - h.conv_id % 20),
step AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS d, turns FROM talk),
spot AS (
  SELECT conv_id, d, array_to_string(turns[:d], '') AS node, array_to_string(turns[:d - 1], '') AS above, turns[d] AS last, d = len(turns) AS over FROM step),
base AS (
  SELECT node, d, any_value(above) AS above, any_value(last) AS last, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256 FROM spot GROUP BY node, d),
kids AS (SELECT above AS node, count(*) AS k FROM base WHERE d > 0 GROUP BY 1),
full_ AS (
  SELECT base.*, coalesce(k, 0) AS n_children, CASE WHEN base.d = 0 THEN 0 ELSE (n_convs - 1) * w END AS own
  FROM base LEFT JOIN kids ON kids.node = base.node LEFT JOIN word ON word.d = base.last),
up AS (SELECT node AS below, n_children, own, substr(node, 1, 32 * unnest(range(0, d + 1))) AS node FROM full_),
sums AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY node)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums ON sums.node = f.node LEFT JOIN base p ON f.d > 0 AND p.node = f.above
"""


@query(TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return trie.prefix_trie(rebuilt(turns), turns.select("conv_id"))
