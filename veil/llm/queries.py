"""One query an operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.chat_tree import chat_trees
from veil.llm.common import shared_path, table
from veil.llm.decontaminate import decontaminate
from veil.llm.exact_dedup import mark_duplicates
from veil.llm.language_id import fit
from veil.llm.line_dedup import drop_repeated_lines
from veil.llm.mixing import mix
from veil.llm.near_dedup import near_duplicates
from veil.llm.registry import ORACLES, QUERIES, query
from veil.llm.substring_dedup import drop_repeated_spans
from veil.llm.token_files import read_token_files, write_token_files
from veil.llm.url_filter import filter_urls
from veil.llm import vector_queries  # noqa: F401  registers its own

WORD_BPE = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Vocabulary files belong to the machines, not to this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontaminate", """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM item_words WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM doc_words, (SELECT DISTINCT n FROM patterns))),
hits AS (SELECT d.doc_id, d.i, d.n, p.item_id FROM doc_windows d JOIN patterns p ON d.pattern = p.pattern AND d.n = p.n),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    marked = decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), width=10)
    hits = F.col("benchmark_hits")
    return marked.select("doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
                         F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"))


@query("op2_exact_dedup", """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST)
""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mark_duplicates(table(spark, sf, "documents"))


# Shares of the tokens by domain. What labels call toxic goes; where low-quality text has more than its share, it is thinned out, too (not in the pipeline).
TARGETS = {"high": 0.82, "low": 0.179, "toxic": 0.0008, "toxic_low": 0.0002}
BUDGET = 1.2


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "toxic_low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


@query("op3_mixing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mixed = mix(docs, domain_labels(table(spark, sf, "labels")), TARGETS, BUDGET)
    m = F.col("mix")
    shares = [F.get(m["posteriors"], F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return mixed.select("doc_id", m["n_tokens"].alias("n_tokens"), *shares, m["rate"].alias("rate"), m["copies"].alias("copies"))


@query("op4_near_dedup", """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM t WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=4, percent=80)


@query("op5_chat_tree", """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(text) + len(regexp_extract_all(text, '\\\\|</?s>|\\[/?INST\\]|<</?SYS>>|\\[ROLE |\\[/ROLE\\]'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END) AS bigint) AS formatted_chars
FROM c WHERE conv_id IS NOT NULL GROUP BY conv_id
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    read = chat_trees(rows.unionByName(own), tokenizer_path("byte_bpe_50k.json"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op8_substring_dedup", """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    left = drop_repeated_spans(table(spark, sf, "documents"), width=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_line_dedup", """
WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], chr(10)) AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM later) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_lines, cast(coalesce(len(ks), 0) AS bigint) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ks, []), i - 1)), chr(10))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_left(table(spark, sf, "documents"), run=3)


def _lines_left(docs: DataFrame, run: int) -> DataFrame:
    left = drop_repeated_lines(docs, run=run)
    blanks = r"^[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]+\z"
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, blanks, "")), lambda x: x != "")
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.array_join(lines, "\n"), 256).alias("kept_sha256"))


# Runs of any length: every later copy of a line goes.
@query("op9_every_line", """
WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT doc_id, i, w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM lines) WHERE n > 1),
gone AS (SELECT doc_id, list(i) AS ks FROM later GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_lines, cast(coalesce(len(ks), 0) AS bigint) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ks, []), i - 1)), chr(10))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
""")
def op9_every_line(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_left(table(spark, sf, "documents"), run=1)


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    guess = F.col("language")
    return model.predict(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), guess["lang"].alias("lang_pred"), guess["score"].alias("score"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op7_url_filter")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages"), RULES).drop("score")


@query("op10_token_files")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), path, tokenizer_path(), END_ID)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def all_queries():
    return dict(QUERIES), dict(ORACLES)
