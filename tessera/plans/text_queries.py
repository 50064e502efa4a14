"""Text, retrieval, URL and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import retrieval
from tessera.plans.base import query
from tessera.tables import table

_TOKENS = r"list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9_''-]+'), lambda t: lower(t))"


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, sha256(array_to_string({_TOKENS.format('text')}, ' ')) AS sha FROM documents")
def t_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("sha"))


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, len(t[i * 120 + 1:i * 120 + 120]) AS n, sha256(array_to_string(t[i * 120 + 1:i * 120 + 120], ' ')) AS sha FROM d, LATERAL (SELECT unnest(range(0, CAST(ceil(len(t) / 120.0) AS BIGINT))) AS i)""")
def t_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 120)
    return out.select("doc_id", "chunk", F.size("tokens").cast("long").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("sha"))


_POSTINGS = f"""d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), p AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM d) GROUP BY doc_id, w),
l AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS len FROM d), f AS (SELECT w, count(*) AS df FROM p GROUP BY w), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q AS (SELECT item_id, w, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS w FROM benchmark) GROUP BY item_id, w),
bm AS (SELECT item_id, p.doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN p ON p.w = q.w JOIN f ON f.w = q.w JOIN l ON l.doc_id = p.doc_id, s GROUP BY item_id, p.doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm),
nd AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM p GROUP BY doc_id), nq AS (SELECT item_id, sqrt(sum(qf * qf)) AS norm FROM q GROUP BY item_id),
co AS (SELECT q.item_id, p.doc_id, round(sum(qf * tf) / (max(nd.norm) * max(nq.norm)), 6) AS score FROM q JOIN p ON p.w = q.w JOIN nd ON nd.doc_id = p.doc_id JOIN nq ON nq.item_id = q.item_id GROUP BY q.item_id, p.doc_id),
cor AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM co)"""


def _best(spark: SparkSession, sf_dir: str, k: int, *kinds: str) -> list[DataFrame]:
    queries = retrieval.postings(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return list(retrieval.best(table(spark, sf_dir, "documents"), queries, k, "doc_id", "text", "item_id", kinds).values())


@query(f"WITH {_POSTINGS} SELECT item_id, doc_id, score, rank FROM bmr WHERE rank <= 5")
def t_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 5, "bm25")[0]


@query(f"WITH {_POSTINGS} SELECT item_id, doc_id, score, rank FROM cor WHERE rank <= 5")
def t_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 5, "cosine")[0]


@query(f"WITH {_POSTINGS}, u AS (SELECT item_id, doc_id, rank FROM bmr WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, rank FROM cor WHERE rank <= 10), r AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY item_id, doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 5")
def t_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_best(spark, sf_dir, 10, "bm25", "cosine"), "item_id", "doc_id", 5)


#: Lines put before a text, by its id, so that every kind of value stands in some of them.
_SAMPLES = ("password = 'hunter2'", "token: os.getenv(TOKEN)", 'api_key="" and jwt=null', "secret=Vault::read, database_url = \"db://x\"", "no secret here", "PASSWORD:process.env.PW; token=abc", "auth_token = Path")
_REDACT = r"""(auth_token|secret|password|jwt|api_key|token|database_url)\s*[:=]\s*[''"]?([^\s''";,]+)[''"]?"""
_SAMPLED = "(SELECT doc_id, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAMPLES) + f"])[doc_id % {len(_SAMPLES)} + 1] || chr(10) || coalesce(text, '') AS text FROM documents)"


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % len(_SAMPLES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(line, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{_REDACT}', '\1=[REDACTED]', 'gi')) AS sha, regexp_matches(text, '{_REDACT}', 'i') AS redacted FROM {_SAMPLED}")
def t_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).select("doc_id", F.sha2(text.redact("text"), 256).alias("sha"), F.col("text").rlike(text.SECRET).alias("redacted"))


@query(rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_REDACT}', 0, 'i')) AS pair, unnest(range(len(regexp_extract_all(text, '{_REDACT}', 0, 'i')))) AS place FROM {_SAMPLED}),
v AS (SELECT doc_id, CAST(place AS INTEGER) AS place, lower(regexp_extract(pair, '^\w+', 0)) AS key, trim(CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) ELSE substr(pair, instr(pair, ':') + 1) END, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM p)
SELECT doc_id, place, key, CASE WHEN regexp_matches(v, '\b(env|getenv|os\.getenv|os\.environ|process\.env)\b', 'i') THEN 'ENV_REFERENCE' WHEN regexp_matches(v, '\b(config|Secret::|Vault::|secrets_manager|key_vault|aws_secrets|Vault|SecretsManager)\b', 'i') THEN 'SECRET_PROVIDER_REFERENCE'
WHEN regexp_matches(v, '\b(storage_path|database_path|base_path|app_path|resource_path|path\.join|Path)\b', 'i') THEN 'STATIC_CONSTANT' WHEN v IN ('', chr(39) || chr(39), '""') THEN 'EMPTY_LITERAL' WHEN lower(v) IN ('null', 'none', 'undefined') THEN 'NULL_LITERAL'
WHEN length(v) > 2 AND (starts_with(v, chr(39)) AND ends_with(v, chr(39)) OR starts_with(v, '"') AND ends_with(v, '"')) THEN 'LITERAL_SECRET' ELSE 'UNKNOWN' END AS kind FROM v""")
def t_secret_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in a text that looks like a secret, and what its value is."""
    return text.secrets(_sampled(spark, sf_dir), "doc_id", "text")


#: Addresses of each zone, judged beside the pages' own.
_PROBES = ("http://169.254.169.254/latest", "http://localhost:80/x", "http://10.1.2.3/", "http://kubernetes.default.svc/api", "http://169.254.1.1/", "http://192.168.0.1/a", "http://127.0.0.1/", "https://example.org/p?q=1")
_URLS = "(SELECT url FROM pages UNION ALL SELECT unnest([" + ", ".join(f"'{u}'" for u in _PROBES) + "]))"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in _PROBES], "url string"))


@query(rf"SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS path FROM {_URLS}")
def t_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", *text.url_parts("url"))


@query(rf"""WITH h AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS h FROM {_URLS})
SELECT url, CASE WHEN h IN ('169.254.169.254', 'metadata.google.internal') THEN 'METADATA' WHEN regexp_matches(h, '^kubernetes(\.default|$)') THEN 'KUBERNETES' WHEN h = 'localhost' OR starts_with(h, '127.') THEN 'LOOPBACK' WHEN starts_with(h, '169.254.') THEN 'LINK_LOCAL'
WHEN regexp_matches(h, '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN 'PRIVATE' WHEN h = '' THEN 'INVALID' ELSE 'PUBLIC' END AS zone FROM h""")
def t_url_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", text.url_zone("url").alias("zone"))


#: Rules: id, the language they hold for (* for all), and the pattern of a line.
RULES = (("R-SCRIPT", "*", "<script"), ("R-HREF", "*", "href="), ("R-LICENSE", "en", "licensed under"), ("R-DE", "de", "nicht"))
_RULE_DIM = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + ") AS r(rule_id, lang, pattern)"


@query(r"SELECT page_id, CAST(i - 1 AS INTEGER) AS line, CASE WHEN regexp_matches(l, '[a-z]+\(') THEN 'call' WHEN contains(l, '=') THEN 'assignment' ELSE 'statement' END AS kind FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM pages) WHERE trim(l, ' ') <> ''")
def r_ast_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "l")).filter(F.trim("l") != "")
    return lines.select("page_id", "line", F.when(F.col("l").rlike(r"[a-z]+\("), "call").when(F.contains("l", F.lit("=")), "assignment").otherwise("statement").alias("kind"))


@query(f"SELECT rule_id, d.doc_id FROM documents d JOIN {_RULE_DIM} ON (r.lang = d.lang OR r.lang = '*') AND contains(d.text, r.pattern)")
def r_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One condition for each rule, all in one pass over the documents; no join."""
    docs = table(spark, sf_dir, "documents")
    hits = [F.when((F.col("lang") == lang if lang != "*" else F.lit(True)) & F.contains("text", F.lit(p)), F.lit(rule)) for rule, lang, p in RULES]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))


@query(f"SELECT d.lang, rule_id, count(*) AS n FROM documents d JOIN {_RULE_DIM} ON r.lang = d.lang OR r.lang = '*' GROUP BY d.lang, rule_id")
def r_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([r[:2] for r in RULES], "rule_id string, key string")
    keys = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.explode(F.array("lang", F.lit("*"))))
    return keys.join(F.broadcast(rules), "key").select("lang", "rule_id", "n")  # a rule set of a few rows

