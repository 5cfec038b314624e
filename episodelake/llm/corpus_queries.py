"""The queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.llm.decontaminate import decontaminate
from episodelake.llm.digests import ordered_sha256
from episodelake.llm.exact_dedup import exact_dedup
from episodelake.llm.license_scan import license_scan
from episodelake.llm.license_texts import TEMPLATES
from episodelake.llm.near_dedup import near_duplicates
from episodelake.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from episodelake.llm.quality import score_quality
from episodelake.llm.sentencepiece_codec import encode_texts
from episodelake.llm.sharding import shard_rows
from episodelake.llm.substring_dedup import remove_repeated_words
from episodelake.llm.suffix_dedup import remove_repeats
from episodelake.llm.token_counts import count_tokens
from episodelake.llm.turn_repair import repair_conversations
from episodelake.llm.warc import archive_round_trip


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in about every fourth row, by the CRC-32 of its id and turn: dropped, emptied, without .!?, twice, or by the user."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *spaced, (F.crc32(name) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    pieces, report = repair_conversations(damaged(conversations))
    kept = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    texts = pieces.select("conv", "piece", "whole", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.when(F.size(kept) > 0, F.array_join(kept, "\n")).alias("text"))
    whole = texts.where("whole").select("conv", "audit", F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))
    rest = texts.where("not whole")
    audits = rest.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("a")).select(F.col("conv").alias("c"), F.array_join(F.col("a.audit"), "").alias("audit"))
    digests = ordered_sha256(rest, "conv", "piece", "text", "\n")
    more = audits.join(digests, F.col("c").eqNullSafe(F.col("conv"))).select("conv", "audit", F.col("sha256").alias("repaired_sha256"))
    results = whole.unionByName(more)
    ids = conversations.select("conv_id").distinct()
    both = results.withColumnRenamed("conv", "c").join(report, F.col("c").eqNullSafe(F.col("conv")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(both, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


#: The words of a text in DuckDB.
SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)

#: CRC-32 of a short ASCII text in DuckDB, byte by byte; ``crc`` is a table of one row that holds the table of bytes.
SQL_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS bigint)] || CAST(range(8) AS bigint[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bytes)"


def sql_crc(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS bigint)), lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = {
    "op11_turn_repair": rf"""
WITH RECURSIVE {SQL_CRC_TABLE},
a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc("concat(coalesce(CAST(conv_id AS varchar), ' '), ':', coalesce(CAST(turn AS varchar), ' '))")} % 20 AS fault FROM conversations, crc),
b AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM a WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM b),
r AS (SELECT conv_id AS c, turn, role, text, i, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
moves(initial, q, q2) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
adds(q, q2, cost, audit, turns) AS (SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), 0, '', CAST([] AS varchar[]) UNION ALL VALUES (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
edits AS (SELECT c, i, q, q2, CASE WHEN m.initial = r.initial THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, CASE WHEN m.initial = r.initial THEN 'K' ELSE 'R' END AS audit,
    [concat(CASE WHEN m.initial = r.initial THEN role WHEN m.initial = 'u' THEN 'user' ELSE 'assistant' END, ':', text)] AS turns
  FROM r JOIN moves m ON m.initial = r.initial OR m.initial <> 's' WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT c, i, q, q, 2, 'D', CAST([] AS varchar[]) FROM r, (SELECT unnest([0, 1, 2, 3]) AS q)),
s(c, i, q, best) AS (SELECT DISTINCT c, CAST(0 AS bigint), 0, struct_pack(cost := 0, audit := '', turns := CAST([] AS varchar[])) FROM r
  UNION ALL SELECT s.c, e.i, e.q2, min(struct_pack(cost := s.best.cost + x.cost + e.cost, audit := concat(s.best.audit, x.audit, e.audit), turns := s.best.turns || x.turns || e.turns))
  FROM s JOIN adds x ON x.q = s.q JOIN edits e ON e.c = s.c AND e.i = s.i + 1 AND e.q = x.q2 GROUP BY s.c, e.i, e.q2),
z AS (SELECT s.c, min(struct_pack(cost := s.best.cost + x.cost, audit := concat(s.best.audit, x.audit), turns := s.best.turns || x.turns)) AS best
  FROM s JOIN (SELECT c, max(i) AS i FROM r GROUP BY c) l ON l.c = s.c AND l.i = s.i JOIN adds x ON x.q = s.q AND x.q2 IN (0, 3) GROUP BY s.c),
t AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM r) GROUP BY c)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS bigint) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN z ON z.c IS NOT DISTINCT FROM n.conv_id LEFT JOIN t ON t.c IS NOT DISTINCT FROM n.conv_id""",
    "op12_prefix_trie": f"""
WITH {SQL_CRC_TABLE},
c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c.*, {sql_crc("CAST(conv_id AS varchar)")} % 6 AS h FROM c, crc),
r AS (SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) AS total FROM r, LATERAL unnest(range(0, len(turns) + 1)) t(d)),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY path) AS node FROM p),
n AS (SELECT node, d AS depth, any_value(path) AS path, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE d = total), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT m.node AS parent, m.d AS depth, count(*) AS n_children FROM n JOIN m ON m.conv_id = n.node AND m.d = n.depth - 1 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, u.node AS parent_conv_id, (n_convs - 1) * coalesce(length(struct_extract(n.path[-1], 'text')), 0) AS saved
  FROM n LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth LEFT JOIN m u ON u.conv_id = n.node AND u.d = n.depth - 1),
s AS (SELECT m.node, m.d AS depth, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, CAST(sum(saved) AS bigint) AS saved_tokens FROM x JOIN m ON m.conv_id = x.node AND m.d <= x.depth GROUP BY m.node, m.d)
SELECT x.node AS conv_id, x.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN s ON s.node = x.node AND s.depth = x.depth""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS bigint) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r""",
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) / 2 AS bigint) AS n FROM d),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM n, LATERAL unnest(range(0, n - 49)) t(p)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, p FROM g JOIN f USING (s) WHERE m < doc_id),
b AS (SELECT DISTINCT doc_id, p + k AS q FROM c, range(50) t(k)),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE q IS DISTINCT FROM before + 1) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS before FROM b) GROUP BY doc_id),
x AS (SELECT n.doc_id, string_agg(substr(h, 2 * q + 1, 2), '' ORDER BY q) AS kept FROM n JOIN r USING (doc_id), LATERAL unnest(range(0, n)) t(q) WHERE (n.doc_id, q) NOT IN (SELECT (doc_id, q) FROM b) GROUP BY n.doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, LATERAL unnest(range(1, len(w) - 48)) t(i)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT i + k) AS q FROM g JOIN f USING (s), range(50) t(k) WHERE m < doc_id GROUP BY doc_id),
b AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1) AS before FROM (SELECT doc_id, unnest(q) AS i FROM c)),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE i <> before + 1) AS n_spans FROM b GROUP BY doc_id),
x AS (SELECT d.doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM d JOIN r USING (doc_id), LATERAL unnest(range(1, len(w) + 1)) t(i) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND b.i = t.i) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN r.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
p AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM d, lens, LATERAL unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT doc_id, i, n, item_id FROM p JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), LATERAL unnest(range(0, n)) t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_license_scan": rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS sh FROM d, LATERAL unnest(range(1, len(w) - 3)) t(i)),
tw AS (SELECT license, {SQL_WORDS} AS w FROM (VALUES {SQL_TEMPLATES}) v(license, text)),
ts AS (SELECT DISTINCT license, len(w) - 4 AS t, array_to_string(w[i:i + 4], ' ') AS sh FROM tw, LATERAL unnest(range(1, len(w) - 3)) t(i)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
m AS (SELECT DISTINCT doc_id, license, t, sh, (CAST(floor(pos / t) AS bigint) - k) * t AS start FROM s JOIN ts USING (sh), (VALUES (0), (1)) x(k) WHERE CAST(floor(pos / t) AS bigint) - k >= 0),
f AS (SELECT doc_id, license, start FROM m JOIN tn USING (license) GROUP BY doc_id, license, start, n HAVING count(*) >= 0.8 * n),
g AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_windows FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(n_windows, 0) AS n_windows
FROM d LEFT JOIN g USING (doc_id)""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_suffix_dedup": op2_suffix_dedup, "op4_quality": op4_quality, "op5_sentencepiece": op5_sentencepiece, "op6_decontamination": op6_decontamination, "op10_license_scan": op10_license_scan, "op7_near_dedup": op7_near_dedup, "op3_token_counts": op3_token_counts, "op8_exact_dedup": op8_exact_dedup, "op9_sharding": op9_sharding, "op11_turn_repair": op11_turn_repair, "op12_prefix_trie": op12_prefix_trie, "op13_substring_dedup": op13_substring_dedup}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
