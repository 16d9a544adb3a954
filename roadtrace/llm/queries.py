"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them.

Each ``opN_<name>`` runs one operator with production parameters over its whole table and derives the
contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm.common import table, training_fold
from roadtrace.llm import alignment, chat, forest, html_text, langid, lexical, quality
from roadtrace.llm.decontaminate import contaminated_words
from roadtrace.llm.licenses import TEMPLATES, license_places
from roadtrace.llm.mixing import mix
from roadtrace.llm.simhash import near_duplicates
from roadtrace.llm.substring_dedup import cut_repeats
from roadtrace.llm.topk import exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


WHITE_WORDS = "[w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> '']"


@query("op1_quality_pu")
def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op2_exact_topk", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""")
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_topk(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


WORDS = ("[w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> '']")


@query("op3_decontaminate", f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS w, least(len(ws), 10) AS size
        FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS w
       FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT doc_id, i, size FROM dw WHERE w IN (SELECT w FROM win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM dw JOIN win USING (w) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _chat_sql() -> str:
    def esc(x: str) -> str:
        out = f"replace(coalesce({x}, ''), '\\', '\\\\')"
        for c in chat.CONTROL:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    marks = len(chat.START + chat.SEP + chat.END)
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             sum({marks} + length({esc("role")}) + length({esc("text")})) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


@query("op4_chat_format", _chat_sql())
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(ok).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    out = chat.expand(turns.unionByName(more))
    turn = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    read = out.select("conv_id", F.col("target").alias("at"), F.length("formatted").alias("chars"),
                      F.when(F.col("last"), F.size(chat.read_turns(F.col("formatted")))).alias("n_turns"),
                      F.when(F.col("last"), F.sha2(F.array_join(turn, ""), 256)).alias("turns_sha256"),
                      chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    read = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "loss")))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x.loss), "")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id"])
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs), keep=["doc_id"])
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2, keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_simhash_dedup")
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


@query("op9_substring_dedup", f"""
WITH d AS (SELECT doc_id, {WHITE_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS w
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win
        QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 19)))) AS cut FROM dup GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(cut), 0) AS r,
             list_filter(ws, lambda w, i: cut IS NULL OR NOT list_contains(cut, i)) AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def _license_sql() -> str:
    def words_of(x: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in x.split()) + "]"

    rows = ", ".join(f"('{t.label}', {t.base}, {words_of(t.text)}, {words_of(t.key)}, {t.key_at})" for t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS v(label, base, body, key, key_at)),
spot AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
p AS (SELECT doc_id, label, base, i - 1 AS start,
             len([j FOR j IN generate_series(1, len(body)) IF i - key_at + j - 1 > 0 AND ws[i - key_at + j - 1] = body[j]]) / len(body) AS score
      FROM spot JOIN t ON ws[i] = key[1] AND list_slice(ws, i, i + len(key) - 1) = key),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
             max(start) FILTER (base) AS last_word, max(score) AS score,
             array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (doc_id)
"""


@query("op10_license_scan", _license_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_places(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p.base)

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p.start)).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p.start)).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.score)), F.lit(0.0)).alias("score"))


@query("op11_nearest")
def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forest.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op12_lexical_search", f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(ws) AS term FROM (SELECT item_id, {WORDS} AS ws FROM benchmark)) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
m AS (SELECT doc_id, 75 + (25 * len(ws) * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return out.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", *alignment.NUMBERS,
                      F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
