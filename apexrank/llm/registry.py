"""The queries opN_<name> over whole tables, and their SQL where SQL can express them in reasonable time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .chat_format import control_case, digest_chats, format_chats
from .common import table
from .decontamination import contaminated
from .language_id import predict_languages
from .license_scan import TEMPLATES, scan_licenses
from .near_dedup import near_duplicates
from .quality_model import score_documents
from .quality_rules import score_quality
from .sharding import assign_shards
from .tokens import encode
from .warc import archive_pages

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_PLAIN = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _window_sql(refs: str) -> str:
    """CTEs up to rs: ws holds the shingles of every window (doc_id, ref, n, st) as long as a reference (ref, text) that has one of its
    shingles anywhere (others have nothing in common), lined the windows where one stands at the reference's first place of it."""
    return f"""it AS (SELECT ref, {_PLAIN.format("text")} AS w FROM ({refs})),
iw AS (SELECT ref, w, len(w) AS n, least(5, len(w)) AS k FROM it WHERE len(w) > 0),
ish AS (SELECT ref, n, k, j, array_to_string(w[j + 1 : j + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS j FROM iw)),
dw AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents),
dsh AS (SELECT doc_id, nw, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
        FROM (SELECT doc_id, w, len(w) AS nw, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM dw, (SELECT DISTINCT k FROM iw))),
hit AS (SELECT DISTINCT d.doc_id, d.nw, d.i, r.ref, r.k, r.n, r.j FROM dsh d JOIN (SELECT ref, n, k, s, min(j) AS j FROM ish GROUP BY ALL) r ON d.s = r.s AND d.k = r.k),
lined AS (SELECT DISTINCT doc_id, ref, greatest(least(i - j, nw - n), 0) AS st, true AS lined FROM hit),
pl AS (SELECT DISTINCT doc_id, ref, k, n, unnest(range(greatest(i - n + k, 0), greatest(least(i, nw - n), 0) + 1)) AS st FROM hit),
ws AS (SELECT p.doc_id, p.ref, p.n, p.st, d.s, count(*) AS c FROM pl p JOIN dsh d ON d.doc_id = p.doc_id AND d.k = p.k AND d.i BETWEEN p.st AND p.st + p.n - p.k GROUP BY ALL),
rs AS (SELECT ref, s, count(*) AS c FROM ish GROUP BY ALL)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document, how many they are, and whether they decode to its text."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by classifiers that learn from its rows that are not held out; see predict_languages()."""
    return predict_languages(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of each license in each document; see scan_licenses()."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdict of each document; see score_quality()."""
    return score_quality(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back, less url and payload; see archive_pages()."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document under the law `bytes`; see assign_shards(). The other law's column is null."""
    return assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document, learned from labels of rows that are not held out; see score_documents()."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item that it holds a copy of; see contaminated()."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all conversations and of the control case, read back from the formatted text; see digest_chats()."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control_case(spark))
    return digest_chats(format_chats(turns))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document, shingles of three words and a similarity of 0.85; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_chat_format": op9_chat_format,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES = {
    "op4_quality_rules": f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
run AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM run) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS d FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
stat AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '\\P{{L}}', '', 'g'))::BIGINT AS n_letters, coalesce(d, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM base b LEFT JOIN cov c USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stat)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_letters < 50 * word_chars            OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM judged""",
    "op3_license_scan": f"""
WITH {_window_sql("SELECT row_number() OVER () AS ref, text FROM (VALUES " + ", ".join(f"({_quoted(t)})" for _, t in TEMPLATES) + ") v(text)")},
name AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, {_quoted(n)})" for i, (n, _) in enumerate(TEMPLATES))}) v(ref, license)),
best AS (
  SELECT ws.doc_id, license, ws.ref, ws.n, st, count(rs.s)::DOUBLE / (SELECT count(*) FROM rs x WHERE x.ref = ws.ref) AS containment
  FROM ws LEFT JOIN rs ON rs.ref = ws.ref AND rs.s = ws.s JOIN name ON name.ref = ws.ref GROUP BY ws.doc_id, license, ws.ref, ws.n, st)
SELECT doc_id, license, st::INT AS start_word, n::INT AS n_words, containment FROM best LEFT JOIN lined USING (doc_id, ref, st) WHERE containment >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, coalesce(lined, false) DESC, st, n DESC) = 1""",
    "op8_decontamination": f"""
WITH {_window_sql("SELECT item_id AS ref, text FROM benchmark")},
size AS (SELECT doc_id, ref, st, sum(c) AS a FROM ws GROUP BY ALL),
common AS (SELECT ws.doc_id, ws.ref, ws.st, sum(least(ws.c, rs.c)) AS c FROM ws JOIN rs ON rs.ref = ws.ref AND rs.s = ws.s GROUP BY ALL),
sim AS (SELECT doc_id, ref, st, c::DOUBLE / (a + (SELECT sum(x.c) FROM rs x WHERE x.ref = common.ref) - c)::DOUBLE AS similarity FROM common JOIN size USING (doc_id, ref, st))
SELECT doc_id, ref AS item_id, st::INT AS start_word, similarity FROM sim LEFT JOIN lined USING (doc_id, ref, st) WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY similarity DESC, coalesce(lined, false) DESC, st) = 1""",
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM g""",
    "op9_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, replace(replace(text, '[', '[~'), '<', '<~') AS esc,
         CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
         ELSE 20 + length(replace(replace(role, '[', '[~'), '<', '<~')) END AS marks
  FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(esc) + marks)::BIGINT AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS shape
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(shape, 's?(ua)+') AS valid
FROM g""",
    "op10_near_dedup": f"""
WITH RECURSIVE base AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM base WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.c, y.c HAVING 100 * count(*) >= 85 * (x.c + y.c - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(low.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
}
