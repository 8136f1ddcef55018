"""The queries of this subpackage, one per operator and the pipeline, and their SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflow.llm import (
    chat,
    decontaminate,
    jaccard,
    langid,
    license_scan,
    line_dedup,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    spelling,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page, their texts as digests and sizes."""
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return made.select(
        F.col("row_key").alias("page_id"), "record_type", "record_id", "refers_to", F.col("uri").alias("url"), "date",
        F.sha2("header", 256).alias("header_sha256"), F.octet_length("block").cast("long").alias("block_bytes"),
        "block_digest", "payload_digest",
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_chats(rows.unionByName(more)))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items; clean documents have no row."""
    report = decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items")
    return report.where("contaminated").select("doc_id", "contaminated", "n_items", items, "least_edits")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(_table(spark, sf_dir, "conversations"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_warc_derivatives,
        op3_mix_sources,
        op4_line_dedup,
        op5_chat_format,
        op6_sharding,
        op7_license_scan,
        op8_decontaminate,
        op9_quality_rules,
        op10_simhash_dedup,
        op11_spelling_variants,
        op12_prefix_trie,
        op13_ngram_jaccard,
    )
}
ORACLES: dict[str, str] = {
    "op3_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS text_key FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
capped AS (
  SELECT key, source_size, 3e0 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM sources),
levels AS (
  SELECT a.key, a.cap / a.weight AS limit_at, a.cap, a.weight,
    (SELECT CAST(sum(source_size) AS DOUBLE) FROM sources)
      - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0e0) AS free,
    sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS open_weight
  FROM capped a, capped b GROUP BY ALL),
found AS (SELECT arg_min(free / open_weight, limit_at) AS level FROM levels WHERE cap > weight * (free / open_weight)),
targets AS (SELECT key, source_size, least(cap, weight * level) AS target FROM capped, found),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.key,
    CASE WHEN t.source_size > 0 THEN CAST(round(t.target / t.source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
    ('0x' || substr(md5('42:offset:' || d.key), 1, 8))::BIGINT % 16777215 AS start,
    row_number() OVER (PARTITION BY d.key ORDER BY
      greatest(length(bin(d.size)) - 5, 0) * 64 + (d.size >> greatest(length(bin(d.size)) - 5, 0)),
      ('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '#' || d.text_key)), 1, 8))::BIGINT,
      d.doc_id, d.size, d.text_key) AS place
  FROM sized d JOIN targets t ON t.key = d.key),
drawn AS (SELECT *, ((start + place * rate) >> 24) - ((start + place * rate - rate) >> 24) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM drawn""",
    "op4_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY r""",
    "op5_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum(4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c')) + 2
      + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + 9)::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id),
judged AS (
  SELECT *, CASE WHEN regexp_full_match(roles, '(system )?user( assistant user)*') THEN 'asked'
    WHEN regexp_full_match(roles, '(system )?user assistant( user assistant)*') THEN 'answered'
    WHEN roles = 'system' THEN 'briefed' ELSE 'rejected' END AS state FROM chats)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars, state, state IN ('asked', 'answered') AS valid FROM judged""",
    "op11_spelling_variants": r"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
-- CRC-32 bit by bit: each byte goes in with the first of its eight steps
fed AS (
  SELECT *, flatten(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'),
    lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS steps FROM counted),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, steps),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) AS h FROM fed),
made AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(generate_series(1, length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS most FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form,
    CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
roots AS (
  WITH RECURSIVE up AS (
    SELECT word, word AS root, 0 AS step FROM formed
    UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
  SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)""",
    "op12_prefix_trie": r"""
WITH numbered AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
chats AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM numbered GROUP BY conv_id),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 4 AS h FROM chats),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN chats b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(turns[depth].text), '[^\x20\x09-\x0D]+')) END AS words
  FROM steps GROUP BY turns[1:depth], depth),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path, depth)),
above AS (SELECT *, unnest(generate_series(0, depth)) AS top FROM known),
sums AS (
  SELECT path[1:top] AS path, top AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (path, depth) LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.path = k.path[1:k.depth - 1]""",
    "op13_ngram_jaccard": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT r, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM docs WHERE len(words) > 0),
sets AS (SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS shingle FROM places),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM sets a JOIN sets b USING (shingle) WHERE a.r <> b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (
  WITH RECURSIVE far AS (SELECT r AS a, r AS b FROM docs UNION SELECT far.a, links.b FROM far JOIN links ON links.a = far.b)
  SELECT a, min(doc_id) AS component_id FROM far JOIN docs ON docs.r = far.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (r) JOIN reach ON reach.a = docs.r""",
}
