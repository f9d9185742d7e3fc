"""Registered queries of the text operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sharding import shuffle_shards

    rows = shuffle_shards(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"),
    )


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
           / greatest(length(translate(coalesce(text, ''), '#*$%&|<>!{}[]^~0123456789', ''))::DOUBLE
                      / greatest(length(coalesce(text, '')), 1), 0.05) AS k
  FROM documents),
s AS (
  SELECT src, none, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         1 + (row_number() OVER (ORDER BY none, src) - 1) % 3 AS w
  FROM d GROUP BY src, none),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate,
         sum(w) OVER b AS wb
  FROM s WINDOW b AS (ORDER BY cap::DOUBLE / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min(rate, coalesce(wb, 0)) AS v FROM r WHERE cap > rate * w),
t AS (SELECT src, none, source_size, least(cap::DOUBLE, coalesce((SELECT v FROM lvl), 1e300) * w) AS target FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS MATERIALIZED (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
         row_number() OVER (PARTITION BY src, none, size > 0 ORDER BY k, doc_id) AS n
  FROM d JOIN e USING (src, none)),
-- One document of each source after the other: taken if it still fits.
walk AS (
  SELECT src, none, 0::BIGINT AS n, 0::BIGINT AS got, false AS fits FROM e
  UNION ALL
  SELECT w.src, w.none, c.n, w.got + CASE WHEN w.got + c.size <= c.rest THEN c.size ELSE 0 END, w.got + c.size <= c.rest
  FROM walk w JOIN c ON c.src = w.src AND c.none = w.none AND c.size > 0 AND c.n = w.n + 1),
g AS (
  SELECT c.*, coalesce(w.fits, false) AS fits, rest - coalesce(max(w.got) OVER (PARTITION BY c.src, c.none), 0) AS gap
  FROM c LEFT JOIN walk w ON w.src = c.src AND w.none = c.none AND w.n = c.n AND c.size > 0),
x AS MATERIALIZED (
  SELECT *, size > 0 AND NOT fits AS out,
         row_number() OVER (PARTITION BY src, none, size > 0 AND NOT fits AND abs(size - gap) < gap ORDER BY abs(size - gap), k, doc_id) AS nth,
         row_number() OVER (PARTITION BY src, none, size > 0 AND NOT fits ORDER BY size, k, doc_id) AS small,
         row_number() OVER (PARTITION BY src, none, fits ORDER BY k DESC, doc_id) AS m,
         least(gap, coalesce(min(CASE WHEN size > 0 AND NOT fits THEN abs(size - gap) END) OVER (PARTITION BY src, none), gap)) AS miss
  FROM g),
-- The smallest document left out, and the taken ones that go for it, the last first.
q AS (SELECT src, none, doc_id, size - gap AS owed, miss FROM x WHERE out AND small = 1 AND miss > 0.01 * target),
back AS (
  SELECT src, none, 0::BIGINT AS m, 0::BIGINT AS got, false AS gone FROM q
  UNION ALL
  SELECT b.src, b.none, x.m, b.got + CASE WHEN b.got + x.size <= q.owed THEN x.size ELSE 0 END, b.got + x.size <= q.owed
  FROM back b JOIN x ON x.src = b.src AND x.none = b.none AND x.fits AND x.m = b.m + 1 JOIN q ON q.src = b.src AND q.none = b.none),
swap AS (SELECT q.src, q.none FROM q JOIN back USING (src, none) GROUP BY q.src, q.none, owed, miss HAVING owed - max(got) < miss)
SELECT x.doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN s.src IS NOT NULL THEN ((fits AND NOT coalesce(gone, false)) OR (out AND small = 1))::INT
                              ELSE (fits OR (out AND abs(size - gap) < gap AND nth = 1))::INT END))::BIGINT AS taken
FROM x LEFT JOIN swap s ON s.src = x.src AND s.none = x.none
       LEFT JOIN back b ON b.src = x.src AND b.none = x.none AND b.m = x.m AND x.fits
"""


@query("op4_mixing", OP4_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix_sources

    rows = mix_sources(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_counts import length_histogram

    return length_histogram(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import MEASURES, quality_rules

    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *MEASURES, "base_failed", "kept", "llr_score")


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secrets import KINDS, find_secrets, span_text

    rows = find_secrets(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base = F.filter("secrets", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select(
        "doc_id", *[count(k) for k in range(3)],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"),
    )


@query("op1_pseudonyms")
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pseudonyms import pseudonymise

    rows = pseudonymise(table(spark, sf_dir, "documents"))
    spans = F.transform("personal", lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"), p["pseudonym"]))
    return rows.select("doc_id", "text", "n_personal", F.array_join(spans, "\n").alias("personal"))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.near_dups import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "class_size", "representative")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontam import contaminated_texts

    return contaminated_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


@query("op8_language_model")
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.conversations import conversation_digests, damaged

    return conversation_digests(damaged(table(spark, sf_dir, "conversations")))


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack_documents

    rows = pack_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, s, phrase, count(*) AS f
  FROM (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
        FROM w, (VALUES (1), (2), (3)) v(s))
  GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE s > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, s)) AS k FROM c),
x AS (
  SELECT k.*, l.f AS l, r.f AS r, (k.a::HUGEINT * k.a * 1000000) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
         JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM x),
o AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS around
      FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE s = 3) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE s = 1 GROUP BY lang),
e AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE nth = 1 AND (around IS NULL OR 100 * around < 50 * a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM e JOIN t USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents")).drop("size")
