"""Thin queries over the llm operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, exact_dedup, language_id, mixing, simhash, spelling, suffix_dedup, token_store, toxicity, url_filter, whitening
from .util import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, scheme=simhash.EXACT).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = "crc32(CAST(doc_id AS STRING)) % 3"
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(f"coalesce({fold} <> 1, false)")
    model = toxicity.toxicity_model(labels, docs)
    return toxicity.score(docs, model).select(
        "doc_id", F.expr(f"coalesce({fold} = 1, false)").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = "crc32(CAST(doc_id AS STRING)) % 4"
    model = language_id.language_model(docs.filter(f"coalesce({fold} <> 2, false)"))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.expr(f"coalesce({fold} = 2, false)").alias("held_out"), "lang_pred", "score")


#: The dated list that op6 applies: (pattern, action, since, seq, category).
URL_EVENTS = """
('spam-farm.example.org', 'block', DATE '2024-01-10', 1, 'spam'),
('cheap-pills.example.com', 'block', DATE '2024-02-01', 1, 'pharma'),
('cheap-pills.example.com', 'off', DATE '2024-06-01', 1, 'pharma'),
('cheap-pills.example.com', 'block', DATE '2024-09-01', 1, 'pharma'),
('tionsh.example.net', 'block', DATE '2024-03-01', 1, 'copies'),
('tionsh.example.net', 'off', DATE '2024-05-01', 1, 'copies'),
('tionsh.example.net/de', 'block', DATE '2024-05-01', 1, 'copies'),
('ththan.example.net', 'block', DATE '2024-01-01', 1, 'malware'),
('blog.ththan.example.net', 'allow', DATE '2024-04-01', 1, 'reviewed'),
('blog.ththan.example.net', 'off', DATE '2024-10-01', 1, 'reviewed'),
('ththth.example.net/en', 'block', DATE '2024-07-01', 1, 'scraped'),
('ththth.example.net/en', 'allow', DATE '2024-07-01', 2, 'reviewed'),
('example.org/fr', 'block', DATE '2024-11-15', 1, 'legal'),
('m.tiontion.example.com', 'block', DATE '2024-08-01', 1, 'spam')"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages hold no fetch time; a page's day is the (page_id mod 366)-th of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(page_id % 366 AS INT))").alias("day"))
    events = spark.sql(f"SELECT * FROM VALUES {URL_EVENTS} AS e(pattern, action, since, seq, category)")
    return url_filter.judge(pages, events).withColumn("day", F.col("day").cast("string"))


OP6_SQL = f"""
WITH e(pattern, action, since, seq, category) AS (VALUES {URL_EVENTS}),
d AS (SELECT pattern, since, max_by(action, seq) AS action, max_by(category, seq) AS category FROM e GROUP BY pattern, since),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM d),
p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day, nullif(regexp_replace(lower(regexp_extract(url, '{url_filter.HOST}', 1)), '[.]$', ''), '') AS host,
  regexp_extract(url, '{url_filter.PATH}', 1) AS path FROM pages),
m AS (SELECT DISTINCT page_id, url, day, pattern, action, category, length(split_part(pattern, '/', 1)) AS a, length(pattern) AS b FROM p JOIN i
  ON day >= since AND (until IS NULL OR day < until) AND action <> 'off'
  AND ('.' || host) LIKE ('%.' || split_part(pattern, '/', 1))
  AND (instr(pattern, '/') = 0 OR (rtrim(regexp_replace(path, '/+', '/', 'g'), '/') || '/') LIKE (substr(pattern, instr(pattern, '/')) || '/%'))),
v AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, day ORDER BY a DESC, b DESC) AS k FROM m)
SELECT p.page_id, p.url, CAST(p.day AS VARCHAR) AS day, p.host, coalesce(v.action = 'block', false) AS blocked, v.pattern, v.category
FROM p LEFT JOIN v ON v.k = 1 AND p.page_id IS NOT DISTINCT FROM v.page_id AND p.url IS NOT DISTINCT FROM v.url AND p.day IS NOT DISTINCT FROM v.day
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found: dict = {}

    def quotas(sizes: dict) -> dict:
        found.update(sizes=sizes)
        return mixing.share_targets(sizes)

    mixed = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), quotas=quotas)
    targets = mixing.source_targets(spark, found["sizes"])
    return mixed.withColumn("source", F.col("sources")[0]).join(
        F.broadcast(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


CHAT_EXTRA = """SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat_format.Template()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(CHAT_EXTRA))
    done = chat_format.format_chats(rows, t).withColumn("turns", chat_format.read_back(F.col("formatted"), t)).withColumn(
        "loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"], t)), ""))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _chat_sql() -> str:
    t = chat_format.Template()
    text = "replace(text, '\\', '\\\\')"
    for s in t.controls:
        text = f"replace({text}, '{s}', '{s[0]}\\{s[1:]}')"
    head = len(t.head) + len(t.mid) + len(t.tail)
    moves = ", ".join(f"('{a}', '{r}')" for (a, r) in t.transitions)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), t, r, '</s>[INST] ok [/INST]' FROM (VALUES (CAST(0 AS BIGINT), 'user'), (1, 'assistant')) v(t, r)),
l AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '{t.start}') AS prev,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({head} + length(role) + length({text})) AS BIGINT) AS formatted_chars,
  bool_and((prev, role) IN ({moves})) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM l GROUP BY conv_id
"""


OP8_SQL = _chat_sql()

def word_tokenizer() -> str:
    """The tokenizer file of the box; only its path is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())
    return token_store.checksums(spark, path)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: has_repeats, whether the document loses any byte, and n_kept, the bytes that remain."""
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (removed > 0).alias("has_repeats"), F.octet_length("kept").cast("long").alias("n_kept"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=97).select("word", "form", "root", "n", "n_near", "form_n")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation of over 63 bits is null here; the operator's own column holds it."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_simhash": op2_simhash, "op3_toxicity": op3_toxicity, "op4_decontaminate": op4_decontaminate,
           "op5_language_id": op5_language_id, "op6_url_filter": op6_url_filter, "op7_mixing": op7_mixing, "op8_chat_format": op8_chat_format, "op9_token_store": op9_token_store,
           "op10_suffix_dedup": op10_suffix_dedup, "op11_spelling": op11_spelling, "op12_whitening": op12_whitening,
           "op13_embedding_dedup": op13_embedding_dedup}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op6_url_filter": OP6_SQL, "op8_chat_format": OP8_SQL}
