"""The training-data operators' queries over the driver's tables, and SQL for those that SQL expresses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, linededup, mixing, ppm, quality, resample, search, simhash, tokenfile, vectors, warc
from .common import id_remainder, shared_folder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of SimHash fingerprints of three-word shingles within 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by family and one-versus-one support vector machines, learned from three of four ids."""
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 4) == 2
    rows = language.identify(docs, docs.where(~held))
    return rows.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "family_pred", "score")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each document of an id divisible by 100 best."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


OP3_SQL = """
WITH w AS (
  SELECT doc_id, unnest(string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')) AS term FROM documents
), t AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
s AS (SELECT d.doc_id, coalesce(l.n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM t GROUP BY 1) l USING (doc_id)),
g AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM s),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
r AS (
  SELECT q.doc_id AS query_id, t.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * s.n / mean))), 6) AS score
  FROM t q JOIN t USING (term) JOIN f USING (term) JOIN s ON s.doc_id = t.doc_id CROSS JOIN g WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal to or one edit from an earlier line."""
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_kept", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), f AS (
  SELECT t, min(doc_id * 4294967296 + pos) AS place, length(t) AS n FROM l WHERE t <> '' GROUP BY t
), h AS (
  SELECT DISTINCT t, place, n, half FROM (
    SELECT t, place, n, 'first' || left(t, (n + d) // 2) AS half FROM f, (VALUES (-1), (0), (1)) AS v(d) WHERE n >= 20
    UNION ALL SELECT t, place, n, 'last' || right(t, (n + d) // 2) FROM f, (VALUES (-1), (0), (1)) AS v(d) WHERE n >= 20)
), near AS (
  SELECT DISTINCT a.t FROM h a JOIN h b ON a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.t, b.t) <= 1
), k AS (
  SELECT l.doc_id, l.pos, l.line, l.t = '' OR (l.doc_id * 4294967296 + l.pos = f.place AND near.t IS NULL) AS kept
  FROM l LEFT JOIN f ON l.t = f.t LEFT JOIN near ON l.t = near.t
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_md5
FROM k GROUP BY doc_id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of 13 words of a benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learned from labelled ids of four in five."""
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: id_remainder(c, 5) != 0)
    return rows.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of documents under a byte model and under word counts of six in seven ids."""
    docs = table(spark, sf_dir, "documents")
    rows = ppm.scores(docs, docs.where(id_remainder(F.col("doc_id"), 7) != 2))
    return rows.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture of sources 5:2:1 takes of each document."""
    rows = mixing.mixture(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents, written to coded files and read back."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, path, summary=True)


# The words of a text, as op5 cuts them
_WORDS = "string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
h AS (SELECT doc_id, item_id, i, n.k FROM p CROSS JOIN (SELECT DISTINCT k FROM g) n JOIN g ON g.k = n.k AND g.gram = array_to_string(w[i:i + n.k - 1], ' ') WHERE i + n.k - 1 <= len(w)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT *, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS keep FROM p),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> (15 - 5 * j)) % 32 + 1, 1), '' ORDER BY g, j) AS digest
  FROM (SELECT page_id, g, j, ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER AS v FROM k, (SELECT unnest(generate_series(0, 7)) AS g), (SELECT unnest(generate_series(0, 3)) AS j)) GROUP BY 1)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS complete
FROM k JOIN c USING (page_id)
"""
OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3 AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
l AS (SELECT *, cap / w AS ratio, ((SELECT sum(source_size)::BIGINT FROM s) * 1.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT ratio, k, level FROM l WHERE ratio > level ORDER BY ratio, k LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN f.k IS NOT NULL AND (l.ratio > f.ratio OR (l.ratio = f.ratio AND l.k >= f.k)) THEN l.w * f.level ELSE cap::DOUBLE END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
x AS (SELECT *, target - whole * source_size AS rest FROM r),
m AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
c AS (SELECT x.source, size, (rest - (source_size - (sum(n * size) OVER (PARTITION BY x.source ORDER BY size))::BIGINT)) / sum(n::DOUBLE * size * size) OVER (PARTITION BY x.source ORDER BY size) AS rate FROM m JOIN x ON m.source IS NOT DISTINCT FROM x.source WHERE rest > 0),
t AS (SELECT source, max(size) AS top, arg_max(rate, size) AS rate FROM c WHERE rate * size <= 1 GROUP BY 1),
u AS (SELECT d.doc_id, d.size, d.source, x.source_size, x.target, x.whole, x.rest, t.top, t.rate * d.size AS pi, (('0x' || left(md5(d.doc_id::VARCHAR), 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN CASE WHEN size > top OR pi >= 1 THEN 0.0::DOUBLE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END END AS odds FROM u),
e AS (SELECT *, CASE WHEN odds IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING) END AS upto FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn by importance for the benchmark's distribution of words."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 of a word's UTF-8 bytes by its table of 256 remainders
_CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda k: ('0x' || substr(hex(word), (2 * k + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc_table)"""


def _op11_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS list FROM documents),
a AS (SELECT doc_id, unnest(list) AS word FROM d),
b AS (SELECT unnest(list_filter({_WORDS}, lambda x: x <> '')) AS word FROM benchmark),
w AS (SELECT word FROM a UNION ALL SELECT word FROM b),
{_CRC},
s AS (SELECT bucket, count(*) AS s FROM a JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS big_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS big_t),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
v AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM a JOIN crc USING (word) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(list)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM h),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM r LEFT JOIN (SELECT * FROM k WHERE rank <= (SELECT 10 * count(*) // 100 FROM k)) USING (doc_id)
"""


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event logs, folded into messages, rendered, written, and read back; with conversation -7, whose log has an edit and a regeneration."""
    log = chat.events(table(spark, sf_dir, "conversations"))
    at = "'turn', {}L, 'role', '', 'digest', X'', 'copy', 1L"
    said = r"r'\### Assistant: </turn> ok'"
    steps = [("message", 0, "'user'", "'hello'"), ("edit", 0, "null", said), ("message", 2, "'assistant'", "'draft'"), ("delta", 2, "null", "' of it'"), ("message", 4, "'user'", "'what?'"), ("regenerate", 2, "null", "null"), ("delta", 2, "null", f"left({said}, 9)"), ("delta", 2, "null", f"substring({said}, 10)")]
    own = spark.sql("SELECT -7L AS conv_id, inline(array(" + ", ".join(f"named_struct('seq', named_struct({at.format(k)}, 'k', 0), 'kind', '{kind}', 'message', named_struct({at.format(m)}), 'role', {role}, 'text', {text})" for k, (kind, m, role, text) in enumerate(steps)) + "))")
    path = f"{shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    chat.render(log.unionByName(own)).write.parquet(path)
    return chat.summary(spark.read.parquet(path))


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:' || replace(replace(regexp_replace(role, '<(\\*)(/?turn)', '<\\\1\2', 'g'), '\', '\b'), '>', '\g') || '>' || chr(10) || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as codes of eight parts of 16 entries, after six rounds over all vectors."""
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec, part, min(struct_pack(far, entry)) AS best FROM (SELECT vec, part, entry, sum((x - c) * (x - c))::BIGINT AS far FROM x JOIN book{r} USING (part, place) GROUP BY ALL) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT part, place, entry, coalesce((s - (s % n + n) % n) // n, c)::BIGINT AS c FROM book{r} LEFT JOIN (SELECT part, place, best.entry AS entry, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN near{r} USING (vec, part) GROUP BY ALL) USING (part, place, entry))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS vec, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS place, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT *, len(embedding) AS n, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, place, vec - 1 AS entry, x AS c FROM x WHERE vec <= 16),
{", ".join(steps)},
coded AS (SELECT vec, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM near{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (vec)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_language, op3_search, op4_line_dedup, op5_decontaminate, op6_quality, op7_ppm, op8_warc, op9_mixture, op10_token_file, op11_resample, op12_chat, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_search": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op8_warc": OP8_SQL, "op9_mixture": OP9_SQL, "op11_resample": _op11_sql(), "op12_chat": OP12_SQL, "op13_vector_codes": _op13_sql()}
