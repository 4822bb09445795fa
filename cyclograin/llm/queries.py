"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclograin.llm import bpe, decontamination, html_text, langid, licenses, lm, nra, phrases, pii, sharding, simhash, vectors, warc
from cyclograin.operators.attach import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.coalesce(langid.held_out("doc_id", 5, 1), F.lit(False)))
    model = lm.learn(docs.filter(~F.col("held_out")))
    found = lm.score(docs, model, "text", ["doc_id", "held_out"])
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.summary(warc.read(spark, archives)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact"
    )


ORACLE["op2_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, n) AS first_id FROM p
)
SELECT page_id,
       n AS payload_bytes,
       list_reduce(list_transform(range(8), lambda i:
         list_reduce(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT >> s) & 31), 1)), lambda x, y: x || y)),
         lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       TRUE AS intact
FROM f
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(langid.held_out("doc_id"), F.lit(False))
    profiles = langid.learn(docs.filter(~out))
    return langid.predict(docs.withColumn("held_out", out), profiles, "text", ["doc_id", "held_out"])


@query
def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE["op4_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), low AS (
  SELECT x, least(x, min(y)) AS low FROM reach GROUP BY x
), n AS (
  SELECT x, count(*) AS n FROM link GROUP BY x
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.low, vec_id) AS component_id,
       vec_id = coalesce(low.low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN low ON low.x = vec_id
"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.scan(docs, decontamination.test_windows(benchmark, "item_id", "text"), "text", ["doc_id"])
    return decontamination.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op6_decontaminate"] = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), t AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d
), h AS (
  SELECT DISTINCT p.doc_id, p.k, t.size, t.item
  FROM (SELECT doc_id, k, s.size, array_to_string(w[k:k + s.size - 1], ' ') AS win
        FROM p, (SELECT DISTINCT size FROM t) s WHERE k + s.size - 1 <= len(w)) p
  JOIN t ON t.win = p.win AND t.size = p.size
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))
    return found.withColumnRenamed("id", "doc_id")


_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
_SPLIT = r"list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE["op8_licenses"] = f"""
WITH t AS (
  SELECT DISTINCT template, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS k
        FROM (SELECT template, {_SPLIT} AS w FROM (VALUES {_TEMPLATES}) AS x(template, text)))
), n AS (
  SELECT template, count(*) AS n_template FROM t GROUP BY template
), d AS (
  SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k
        FROM (SELECT doc_id, {_SPLIT} AS w FROM documents))
), m AS (
  SELECT doc_id, template, count(DISTINCT s) AS n_shared, min(k) - 1 AS first_word, max(k) + 3 AS last_word
  FROM d JOIN t USING (s) GROUP BY doc_id, template
)
SELECT doc_id, template, n_shared, n_template, n_shared / n_template AS containment, first_word, last_word
FROM m JOIN n USING (template) WHERE n_shared / n_template >= 0.8
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    codec = bpe.Codec(docs, "text", vocabulary_path())
    return bpe.round_trip(docs, codec, "text", ["doc_id"])


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), least=100, top=2000)


ORACLE["op11_phrases"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(part, ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, k, w[i:i + k - 1] AS part
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k))
  GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS s FROM g WHERE k > 1 AND f >= 100
), dropped AS (
  SELECT DISTINCT lang, part AS phrase FROM (
    SELECT lang, f, unnest([array_to_string(s[1:k - 1], ' '), array_to_string(s[2:k], ' ')]) AS part FROM c) x
  WHERE f >= (SELECT max(f) FROM g WHERE g.lang = x.lang AND g.phrase = x.part)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(s[1:j], ' ') AS head, array_to_string(s[j + 1:k], ' ') AS rest
  FROM c, range(1, 5) AS r(j) WHERE j < k AND (c.lang, c.phrase) NOT IN (SELECT (lang, phrase) FROM dropped)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, n, j,
         CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts JOIN g h ON h.lang = cuts.lang AND h.phrase = head
            JOIN g t ON t.lang = cuts.lang AND t.phrase = rest
            JOIN n ON n.lang = cuts.lang
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS low FROM scored
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
         phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM weakest WHERE low = 1
) WHERE rank <= 2000
"""


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), "text", ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _matches(kind: str, order: int, pattern: str, test: str = "TRUE", tail: str = "m") -> str:
    """Spans of one pattern in SQL: places follow from the lengths of what lies between the matches."""
    return f"""
SELECT doc_id, '{kind}' AS kind, {order} AS ord, stop - len({tail}) AS start, stop
FROM (SELECT doc_id, ms[i] AS m, list_sum([len(x) for x in ps[1:i]]) + list_sum([len(x) for x in ms[1:i]]) AS stop
      FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps
                  FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""len({_DIGITS}) BETWEEN 14 AND 19 AND list_sum([
    CASE WHEN (len({_DIGITS}) - j) % 2 = 0 THEN {_DIGITS}[j]::INT
         ELSE ({_DIGITS}[j]::INT * 2) - CASE WHEN {_DIGITS}[j]::INT > 4 THEN 9 ELSE 0 END END
    for j in range(1, len({_DIGITS}) + 1)]) % 10 = 0"""
_ID = "regexp_extract(m, '[A-Za-z0-9]+(-[A-Za-z0-9]+)*$')"
_ID_TEST = f"len(replace({_ID}, '-', '')) <= 34 AND len(regexp_replace({_ID}, '[^0-9]', '', 'g')) >= 5"
_PII = [
    _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    _matches("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([x for x in string_split(m, '.') if len(ltrim(x, '0')) > 3 OR x::HUGEINT > 255]) = 0"),
    _matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15"),
    _matches("url", 4, r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/@?#\"<>]+@[A-Za-z0-9.-]+[^\x00-\x20\"<>]*"),
    *[_matches("account", 5, rf"(?i:\b{cue})[ \t:=#.]{{1,4}}[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", _ID_TEST, _ID) for cue in pii.CUES],
]
ORACLE["op12_pii"] = f"""
WITH s AS ({" UNION ".join(_PII)}
), a AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip,
         count(*) FILTER (ord = 2) AS n_card, count(*) FILTER (ord = 3) AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (ord < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""


@query
def op13_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE["op13_nra_search"] = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS w FROM documents
), i AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL
), c AS (
  SELECT count(*) AS n_docs, sum(len(w)) AS total FROM d WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM i) GROUP BY ALL
), f AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs
), s AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN f USING (t), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
