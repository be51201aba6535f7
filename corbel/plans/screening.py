"""Queries of rules, texts, sources and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect, evidence, ops, policy
from ..operators.detect import HOSTED, Rule
from ..session import spread, table

#: The hosted rules, and some whose phrases occur in the driver's texts.
RULES = (
    *HOSTED,
    Rule("license-text", "license", "SOURCE_IMPERSONATION", "low", "review"),
    Rule("secret-assignment", 'token = "', "TOOL_COERCION", "high", "block"),
    Rule("scoped-phrase", "of the", "INDIRECT_INSTRUCTION_OVERRIDE", "low", "allow", tenants=("en",), sources=("src0", "src1")),
)
CHAT_RULES = (Rule("assistant-phrase", "the ", "TOOL_COERCION", "medium", "review", tenants=("assistant",)), Rule("any-phrase", "and th", "INDIRECT_INSTRUCTION_OVERRIDE", "low", "allow"), Rule("system-phrase", "is a", "SOURCE_IMPERSONATION", "high", "block", tenants=("system", "user")))


def _sql_list(xs: tuple[str, ...] | None) -> str:
    return "NULL::VARCHAR[]" if xs is None else "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _rules_sql(rules: tuple[Rule, ...]) -> str:
    rows = ", ".join(f"('{r.id}', '{r.phrase}', '{r.reason}', '{r.severity}', '{r.disposition}', {_sql_list(r.tenants)}, {_sql_list(r.sources)})" for r in rules)
    return f"rules(rule_id, phrase, reason_code, severity, disposition, tenants, sources) AS (VALUES {rows})"


_PLACES_SQL = """k AS (SELECT *, unnest(generate_series(1, len(pieces) - 1)) AS k FROM hit
    ), p AS (SELECT *, (list_sum(list_transform(pieces[1:k], lambda x: length(x))) + (k - 1) * length(phrase))::BIGINT AS s FROM k
    ), f AS (SELECT id, rule_id, reason_code, severity, disposition, s AS "start", s + length(phrase) AS "end", left(text, s) AS a, left(text, s + length(phrase)) AS b FROM p
    ), found AS (SELECT id, rule_id, reason_code, severity, disposition, "start", "end",
      len(string_split(a, chr(10))) AS start_line, length(string_split(a, chr(10))[-1]) + 1 AS start_column,
      len(string_split(b, chr(10))) AS end_line, length(string_split(b, chr(10))[-1]) + 1 AS end_column FROM f)"""


def _findings_sql(rules: tuple[Rule, ...], table_sql: str) -> str:
    """Over ``t(id, text, tenant, source)``."""
    return f"""{_rules_sql(rules)}, t AS ({table_sql}), hit AS (
      SELECT t.id, t.text, r.*, string_split(lower(t.text), r.phrase) AS pieces FROM t JOIN rules r
      ON (r.tenants IS NULL OR list_contains(r.tenants, t.tenant)) AND (r.sources IS NULL OR list_contains(r.sources, t.source)) AND contains(lower(t.text), r.phrase)
    ), {_PLACES_SQL}"""


_DOCS = "SELECT doc_id AS id, text, lang AS tenant, source FROM documents"
_RANK = "CASE disposition WHEN 'block' THEN 2 WHEN 'review' THEN 1 ELSE 0 END"


def _doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(table(spark, sf_dir, "documents"), RULES, "doc_id", "text", "lang", "source")


def _item_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 24 characters of all benchmark items as rules, and the first nine of each item: hundreds to thousands."""
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    every = F.concat(F.transform(F.regexp_extract_all("text", F.lit("(?s).{24}"), F.lit(0)), lambda p, i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("kind"), p.alias("phrase"))), F.array(F.struct(F.lit("s").alias("kind"), F.left("text", F.lit(9)).alias("phrase"))))
    rows = items.select("item_id", F.explode(every).alias("x")).select(F.concat(F.col("item_id").cast("string"), F.lit("-"), F.col("x.kind")).alias("id"), "x.phrase", "item_id").where(F.char_length("phrase") >= 3)
    scope = F.when(F.col("item_id") % 5 == 0, F.array(F.lit("en")))
    return rows.select("id", "phrase", F.lit("TOOL_COERCION").alias("reason"), F.lit("low").alias("severity"), F.when(F.col("item_id") % 2 == 0, "block").otherwise("review").alias("disposition"), scope.alias("tenants"), F.lit(None).cast("array<string>").alias("sources"))


def scan_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of thousands of phrases in documents, with its place: grams of texts meet those of the phrases."""
    return detect.many(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), _item_rules(spark, sf_dir), "doc_id", "text", "lang", "source")


def scan_rules_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every rule's phrase in documents, with its place."""
    return _doc_findings(spark, sf_dir)


SCAN_MANY_RULES = f"""WITH c AS (SELECT item_id, text, unnest(generate_series(0, length(text) // 24 - 1)) AS i FROM benchmark),
rules AS (SELECT item_id || '-w' || i AS rule_id, substr(text, 24 * i + 1, 24) AS phrase, item_id FROM c UNION ALL SELECT item_id || '-s', left(text, 9), item_id FROM benchmark WHERE length(text) >= 3),
r AS (SELECT rule_id, lower(phrase) AS phrase, 'TOOL_COERCION' AS reason_code, 'low' AS severity, CASE WHEN item_id % 2 = 0 THEN 'block' ELSE 'review' END AS disposition, item_id % 5 = 0 AS scoped FROM rules),
hit AS (SELECT doc_id AS id, text, r.*, string_split(lower(text), phrase) AS pieces FROM documents JOIN r ON (NOT scoped OR lang = 'en') AND contains(lower(text), phrase)), {_PLACES_SQL} SELECT id AS doc_id, * EXCLUDE (id) FROM found"""
SCAN_RULES_FINDINGS = f"WITH {_findings_sql(RULES, _DOCS)} SELECT id AS doc_id, * EXCLUDE (id) FROM found"


def scan_rules_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's most restrictive disposition and reasons."""
    return detect.decide(table(spark, sf_dir, "documents"), RULES, "doc_id", "text", "lang", "source")


SCAN_RULES_DISPOSITION = f"""WITH {_findings_sql(RULES, _DOCS)}
SELECT t.id AS doc_id, CASE coalesce(max({_RANK}), 0) WHEN 2 THEN 'block' WHEN 1 THEN 'review' ELSE 'allow' END AS disposition, count(rule_id) AS n_findings,
  coalesce(string_agg(DISTINCT reason_code, ',' ORDER BY reason_code), '') AS reason_codes FROM t LEFT JOIN found ON t.id = found.id GROUP BY t.id"""


def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in conversation turns, rules scoped by role."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text", "role")
    return detect.findings(rows, CHAT_RULES, "turn_id", "text", "role")


SCAN_CONVERSATIONS = f"WITH {_findings_sql(CHAT_RULES, 'SELECT conv_id || chr(58) || turn AS id, text, role AS tenant, NULL::VARCHAR AS source FROM conversations')} SELECT id AS turn_id, * EXCLUDE (id) FROM found"


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and documents by rule."""
    return _doc_findings(spark, sf_dir).groupBy("rule_id", "disposition").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


RULE_COUNTS = f"WITH {_findings_sql(RULES, _DOCS)} SELECT rule_id, disposition, count(*) AS n, count(DISTINCT id) AS n_docs FROM found GROUP BY ALL"


def occurrence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of all occurrences of a phrase, as text."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return docs.select("doc_id", F.array_join(T.occurrences(F.lower("text"), F.lit("the")).cast("array<string>"), ",").alias("starts"))


OCCURRENCE_POSITIONS = """WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS x FROM documents WHERE contains(lower(text), 'the')),
k AS (SELECT doc_id, k, length(array_to_string(x[1:k], 'the')) AS s FROM (SELECT *, unnest(generate_series(1, len(x) - 1)) AS k FROM p))
SELECT doc_id, string_agg(s, ',' ORDER BY k) AS starts FROM k GROUP BY doc_id"""


def line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the middle of each text."""
    docs = table(spark, sf_dir, "documents").withColumn("at", F.floor(F.char_length("text") / 2).cast("int"))
    return docs.select("doc_id", "at", T.line(F.col("text"), F.col("at")).alias("line"), T.column(F.col("text"), F.col("at")).alias("column"))


LINE_COLUMN = """WITH p AS (SELECT doc_id, length(text) // 2 AS "at", string_split(left(text, length(text) // 2), chr(10)) AS x FROM documents)
SELECT doc_id, "at", len(x) AS line, length(x[-1]) + 1 AS "column" FROM p"""


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns that likely hold a secret."""
    docs = table(spark, sf_dir, "documents").where(T.has_secret(F.col("text"))).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    chat = table(spark, sf_dir, "conversations").where(T.has_secret(F.col("text"))).select(F.lit("turn").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    return docs.unionByName(chat)


_SECRET = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in T.SECRETS)
SECRET_SCAN = f"SELECT 'document' AS kind, doc_id::VARCHAR AS id FROM documents WHERE {_SECRET} UNION ALL SELECT 'turn', conv_id || ':' || turn FROM conversations WHERE {_SECRET}"


def space_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of texts with white space collapsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").alias("n"), T.digest(F.col("t").cast("binary")).alias("digest"))


SPACE_COLLAPSE = "SELECT doc_id, length(t) AS n, 'sha256:' || sha256(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents)"


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content was seen before, marked and kept: the first of a digest is its smallest id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.digest(F.col("text").cast("binary")).alias("content_digest"))
    first = docs.groupBy("content_digest").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "content_digest").select("doc_id", "content_digest", "first_id", F.when(F.col("doc_id") == F.col("first_id"), "current").otherwise("duplicate").alias("state"))


CONTENT_DEDUP = """WITH d AS (SELECT doc_id, 'sha256:' || sha256(text) AS content_digest FROM documents)
SELECT *, min(doc_id) OVER (PARTITION BY content_digest) AS first_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY content_digest) THEN 'current' ELSE 'duplicate' END AS state FROM d"""


def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page URLs may be fetched, and why others may not."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.host(F.col("url")).alias("host"), F.coalesce(T.url_block_reason(F.col("url")), F.lit("")).alias("blocked"))


URL_ADMISSION = """SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, CASE WHEN NOT starts_with(url, 'https:') THEN 'SCHEME_BLOCKED' ELSE '' END AS blocked FROM pages"""


def host_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host."""
    return table(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


HOST_EXTRACT = "SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1"


def source_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as observations of registered sources: one record a residue of the page id, some revoked, some without a record."""
    pages = table(spark, sf_dir, "pages").withColumn("source_id", F.concat(F.lit("s"), F.col("page_id") % 7))
    o = pages.select("page_id", "source_id", F.col("url").alias("final_url"), F.array("url").alias("redirect_urls"), F.col("url").startswith("https:").alias("tls_verified"), F.when(F.col("page_id") % 3 == 0, F.lit("Alias")).when(F.col("page_id") % 3 == 1, F.lit("Other")).alias("publisher_metadata"))
    hosts = pages.where("source_id <> 's6'").select("source_id", T.host(F.col("url")).alias("h"), "page_id").where("page_id % 2 = 0")
    records = hosts.groupBy("source_id").agg(F.collect_set("h").alias("domains")).select("source_id", "domains", F.lit("Publisher").alias("publisher"), F.array(F.lit("Alias")).alias("aliases"), F.when(F.col("source_id") == "s3", "revoked").otherwise("approved").alias("review_state"))
    return evidence.verify_sources(o, records).select("page_id", "source_id", "disposition", "reasons")


SOURCE_VERIFICATION = """WITH p AS (SELECT page_id, 's' || page_id % 7 AS source_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM pages),
r AS (SELECT source_id, list(DISTINCT h) AS domains FROM p WHERE source_id <> 's6' AND page_id % 2 = 0 GROUP BY 1),
x AS (SELECT page_id, p.source_id, CASE WHEN r.source_id IS NULL THEN 'SOURCE_NOT_REGISTERED' ELSE concat_ws(',',
  CASE WHEN NOT list_contains(domains, h) THEN 'FINAL_DOMAIN_MISMATCH' END, CASE WHEN page_id % 3 = 1 THEN 'PUBLISHER_METADATA_MISMATCH' END,
  CASE WHEN NOT list_contains(domains, h) THEN 'REDIRECT_DOMAIN_MISMATCH' END, CASE WHEN p.source_id = 's3' THEN 'SOURCE_REVOKED' END, CASE WHEN NOT starts_with(url, 'https:') THEN 'TLS_UNVERIFIED' END) END AS reasons
FROM p LEFT JOIN r ON p.source_id = r.source_id)
SELECT page_id, source_id, CASE reasons WHEN 'SOURCE_NOT_REGISTERED' THEN 'unknown' WHEN '' THEN 'verified' ELSE 'mismatch' END AS disposition, reasons FROM x"""


def base64_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that look like base64, counted with those that decode to text."""
    return detect.base64_tokens(table(spark, sf_dir, "documents"), "doc_id", "text").where("n_tokens > 0")


BASE64_SCAN = """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/]{8,}={0,2}') AS x FROM documents),
u AS (SELECT doc_id, len(x) AS n_tokens, unnest(x) AS v FROM t WHERE len(x) > 0), b AS (SELECT *, rtrim(v, '=') AS bare FROM u),
d AS (SELECT doc_id, n_tokens, CASE WHEN length(v) % 4 = 0 OR (v = bare AND length(v) % 4 <> 1) THEN TRY(decode(from_base64(rpad(bare, ((length(bare) + 3) // 4 * 4)::INTEGER, '=')))) END AS s FROM b)
SELECT doc_id, any_value(n_tokens)::INTEGER AS n_tokens, (count(*) FILTER (strlen(s) <= 65536 AND regexp_matches(s, '[\\p{L}\\p{N}]')))::INTEGER AS n_decoded FROM d GROUP BY 1"""


def revenue_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue statements: sentences made of order totals, as the prose has none."""
    unit = F.element_at(F.array(*map(F.lit, ("million", "Billion", "billion", "dollars"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("For the year Revenue "), F.when(F.col("o_orderkey") % 2 == 0, "was").otherwise("of"), F.lit(" $"), F.col("o_custkey"), F.lit(".5 "), unit, F.lit(" in all"))
    orders = table(spark, sf_dir, "orders").withColumn("text", F.when(F.col("o_orderkey") % 5 != 0, text).otherwise("no figure"))
    return evidence.revenue_claims(orders, "o_orderkey", "text")


REVENUE_EXTRACT = """WITH t AS (SELECT o_orderkey, o_custkey, 'For the year Revenue ' || CASE WHEN o_orderkey % 2 = 0 THEN 'was' ELSE 'of' END || ' $' || o_custkey || '.5 ' AS head, ['million','Billion','billion','dollars'][o_orderkey % 4 + 1] AS unit
  FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey, (o_custkey || '.5')::DOUBLE AS n, unit, regexp_extract(head || unit || ' in all', '(?i)revenue\\s+(?:was|of)\\s+\\$?(\\d+(?:\\.\\d+)?)\\s*(million|billion)?') AS claim FROM t)
SELECT o_orderkey, n * CASE unit WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 ELSE 1.0 END AS "value", 13 AS "start", 13 + length(claim) AS "end", claim, unit = 'Billion' AS multiplier_ignored FROM c"""


def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies over documents: findings from labels and rules, controls and evidence from ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"))
    labels = table(spark, sf_dir, "labels")
    kinds = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.struct(F.lit("direct_prompt_injection").alias("category"), F.lit("high").alias("severity"))), F.when(F.col("quality") == 0, F.struct(F.lit("other").alias("category"), F.lit("medium").alias("severity")))))
    of_labels = labels.select(F.col("doc_id").alias("subject"), F.inline(kinds))
    of_rules = _doc_findings(spark, sf_dir).select(F.col("doc_id").alias("subject"), F.when(F.col("rule_id") == "secret-assignment", "secret").otherwise("obfuscation").alias("category"), "severity")
    controls = docs.where("subject % 11 = 0").select("subject", (F.col("subject") % 2 == 0).alias("required"), F.lit("evidence").alias("class"), F.lit("unavailable").alias("status"))
    proof = docs.where("subject % 13 = 0").select("subject", F.lit(True).alias("required"), F.lit(8000).alias("minimum_bps"), F.array(F.lit(9100), (F.col("subject") % 10_000).cast("int")).alias("claim_bps"), (F.col("subject") % 26 == 0).alias("material_conflict"))
    rules = docs.where("subject % 17 = 0").select("subject", F.when(F.col("subject") % 34 == 0, "permit").otherwise("review").alias("action"), F.lit("WORKSPACE_REVIEW_REQUIRED").alias("reason_code"), F.lit("workspace").alias("layer"))
    return policy.evaluate(docs, policy.from_findings(of_labels.unionByName(of_rules)), policy.from_controls(controls), policy.from_evidence(proof), policy.from_rules(rules), policy.from_availability(docs.select("subject", (F.col("subject") % 101 != 0).alias("available"))))


POLICY_VERDICTS = f"""WITH {_findings_sql(RULES, _DOCS)}, c(subject, rank, reason) AS (
  SELECT doc_id, 2, 'FINDING_HIGH' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1, 'FINDING_MEDIUM' FROM labels WHERE quality = 0
  UNION ALL SELECT id, CASE rule_id WHEN 'secret-assignment' THEN 2 ELSE CASE severity WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE 2 END END, CASE WHEN rule_id = 'secret-assignment' THEN 'UNKNOWN_FINDING_CATEGORY' WHEN severity <> 'low' THEN 'FINDING_' || upper(severity) END FROM found
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 2 = 0 THEN 'REQUIRED_EVIDENCE_CONTROL_UNAVAILABLE' ELSE 'OPTIONAL_CONTROL_UNAVAILABLE' END FROM documents WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id, 1, 'EVIDENCE_BELOW_THRESHOLD' FROM documents WHERE doc_id % 13 = 0 AND doc_id % 10000 < 8000
  UNION ALL SELECT doc_id, 1, 'MATERIAL_CONFLICT_UNRESOLVED' FROM documents WHERE doc_id % 26 = 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 34 = 0 THEN 2 ELSE 1 END, CASE WHEN doc_id % 34 = 0 THEN 'UNKNOWN_POLICY_ACTION' ELSE 'WORKSPACE_REVIEW_REQUIRED' END FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT doc_id, 2, 'POLICY_NO_MATCH' FROM documents WHERE doc_id % 101 = 0)
SELECT d.doc_id AS subject, CASE coalesce(max(rank), 0) WHEN 2 THEN 'block' WHEN 1 THEN 'review' ELSE 'allow' END AS disposition, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reason_codes
FROM documents d LEFT JOIN c ON d.doc_id = c.subject GROUP BY 1"""


def classifier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule verdicts with a model's view from labels, which may be missing."""
    base = detect.decide(table(spark, sf_dir, "documents"), RULES, "doc_id", "text", "lang", "source")
    m = base.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    model = F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "review").otherwise("allow")
    return m.select("doc_id", F.col("disposition").alias("deterministic"), policy.merge_model(F.col("disposition"), model, F.col("toxic").isNotNull()).alias("merged"))


CLASSIFIER_MERGE = f"""WITH {_findings_sql(RULES, _DOCS)}, d AS (SELECT t.id AS doc_id, coalesce(max({_RANK}), 0) AS a FROM t LEFT JOIN found ON t.id = found.id GROUP BY 1),
m AS (SELECT d.doc_id, a, CASE WHEN toxic IS NULL THEN 1 WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS b FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, ['allow','review','block'][a + 1] AS deterministic, ['allow','review','block'][greatest(a, b) + 1] AS merged FROM m"""


def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector quality on labelled documents: toxic ones are attacks, their category is the language."""
    hit = F.lower("text").rlike("idiot|pathetic|worthless|stupid")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("toxic") == 1).alias("attack"), hit.alias("hit"))
    by = rows.groupBy(F.when(F.col("attack"), F.concat(F.lit("recall:"), "lang")).otherwise("false_positives").alias("measure")).agg(F.count("*").alias("samples"), F.count_if("hit").alias("detected"))
    every = rows.agg(F.lit("attack_block_rate").alias("measure"), F.count_if("attack").alias("samples"), F.count_if(F.col("attack") & F.col("hit")).alias("detected"))
    return by.unionByName(every).select("measure", "samples", "detected", ops.bps(F.col("detected"), F.col("samples")).alias("rate_bps"))


BENCHMARK_EVAL = """WITH r AS (SELECT lang, toxic = 1 AS attack, regexp_matches(lower(text), 'idiot|pathetic|worthless|stupid') AS hit FROM documents JOIN labels USING (doc_id)),
m AS (SELECT CASE WHEN attack THEN 'recall:' || lang ELSE 'false_positives' END AS measure, count(*) AS samples, count(*) FILTER (hit) AS detected FROM r GROUP BY 1
UNION ALL SELECT 'attack_block_rate', count(*) FILTER (attack), count(*) FILTER (attack AND hit) FROM r)
SELECT *, CASE WHEN samples = 0 THEN 10000 ELSE floor(detected / samples * 10000 + 0.5)::BIGINT END AS rate_bps FROM m"""


def corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the labelled corpus: violations of each, all of them zero or listed."""
    docs, labels, items = (table(spark, sf_dir, n) for n in ("documents", "labels", "benchmark"))
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    return (
        one("duplicate_ids", docs.groupBy("doc_id").count().where("count > 1"))
        .unionByName(one("labels_without_document", labels.join(docs, "doc_id", "left_anti")))
        .unionByName(one("label_out_of_range", labels.where("quality not in (0, 1) or toxic not in (0, 1)")))
        .unionByName(one("length_differs", docs.where(F.char_length("text") != F.col("n_chars"))))
        .unionByName(one("languages_without_label", docs.select("lang").distinct().exceptAll(docs.join(labels, "doc_id", "left_semi").select("lang").distinct())))
        .unionByName(one("empty_items", items.where("trim(text) = ''")))
    )


CORPUS_CHECKS = """SELECT 'duplicate_ids' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'label_out_of_range', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'length_differs', count(*) FROM documents WHERE length(text) <> n_chars
UNION ALL SELECT 'languages_without_label', count(*) FROM (SELECT lang FROM documents EXCEPT SELECT lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'empty_items', count(*) FROM benchmark WHERE trim(text) = ''"""

QUERIES = (
    scan_many_rules, scan_rules_findings, scan_rules_disposition, scan_conversations, rule_counts, occurrence_positions, line_column, secret_scan, space_collapse, content_dedup, url_admission, host_extract, source_verification, base64_scan,
    revenue_extract, policy_verdicts, classifier_merge, benchmark_eval, corpus_checks,
)
