"""Source trees: documents stand for files, their path made from source, language and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lookup
from tessera.plans.base import query
from tessera.plans.graph_queries import _nid, _traversal
from tessera.sources import files
from tessera.tables import table

FOLDERS = ("src", "node_modules/pkg", ".github/workflows", ".cache", "k8s/templates", "a/vendor/b")
FILES = ("main.py", "app.TS", "Dockerfile", "dockerfile.dev", "values.yaml", "ci.yml", "go.mod", "x.generated.py", "yarn.lock", "notes.txt", "infra.tf", "package.json", "lib.rb")
_FILES = "f AS (SELECT doc_id, ([{}])[doc_id % {} + 1] || '/' || ([{}])[doc_id % {} + 1] AS path, CASE WHEN doc_id % 4 = 0 THEN 'on: push jobs: x' WHEN doc_id % 4 = 1 THEN 'apiVersion: v1 kind: Pod' ELSE coalesce(text, '') END AS content FROM documents)".format(", ".join(f"'{x}'" for x in FOLDERS), len(FOLDERS), ", ".join(f"'{x}'" for x in FILES), len(FILES))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    content = F.when(F.col("doc_id") % 4 == 0, "on: push jobs: x").when(F.col("doc_id") % 4 == 1, "apiVersion: v1 kind: Pod").otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", pick(FOLDERS), pick(FILES)).alias("path"), content.alias("content"))


@query(f"WITH {_FILES} SELECT doc_id, path FROM f WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor|\\.cache)/') AND NOT ends_with(path, '.generated.py') AND NOT ends_with(path, 'yarn.lock') AND regexp_matches(lower(path), '(\\.(py|ts|yaml|yml|json|tf)|/dockerfile(\\.[a-z]+)?)$') AND NOT (path LIKE '%main.py' AND starts_with(path, 'k8s'))")
def src_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files.candidates(tree(spark, sf_dir), ignore=[("!src/*", True), ("k8s/*/main.py", False)])
    return own.select("doc_id", "path")


@query(f"WITH {_FILES} SELECT doc_id, CASE WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, '.TS') THEN 'TypeScript' WHEN ends_with(path, '.rb') THEN 'Ruby' WHEN ends_with(path, '/go.mod') THEN 'Go' WHEN ends_with(path, '/package.json') THEN 'JavaScript/TypeScript' END AS language FROM f")
def src_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("doc_id", files.language().alias("language"))


@query(f"""WITH {_FILES}, g AS (SELECT doc_id, lower(split_part(path, '/', -1)) AS n, path, content FROM f)
SELECT doc_id, CASE WHEN starts_with(n, 'dockerfile') THEN 'DOCKERFILE' WHEN contains(path, '.github/workflows') THEN 'GITHUB_ACTIONS' WHEN regexp_matches(n, 'ya?ml$') AND contains(content, 'on:') AND contains(content, 'jobs:') THEN 'GITHUB_ACTIONS' WHEN regexp_matches(n, 'ya?ml$') AND contains(content, 'apiVersion:') AND contains(content, 'kind:') THEN 'KUBERNETES'
WHEN regexp_matches(n, 'ya?ml$') AND (contains(path, 'templates/') OR n = 'values.yaml') THEN 'HELM' WHEN regexp_matches(n, 'ya?ml$') THEN 'KUBERNETES' WHEN ends_with(n, '.tf') THEN 'TERRAFORM' WHEN ends_with(n, '.py') THEN 'PYTHON' WHEN ends_with(n, '.ts') THEN 'TYPESCRIPT' END AS format FROM g""")
def src_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("doc_id", files.target().alias("t")).select("doc_id", F.col("t.format").alias("format"))


@query(f"WITH {_FILES}, g AS (SELECT CASE WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, '.TS') THEN 'TypeScript' WHEN ends_with(path, '.rb') THEN 'Ruby' WHEN ends_with(path, '/go.mod') THEN 'Go' WHEN ends_with(path, '/package.json') THEN 'JavaScript/TypeScript' END AS language, CAST(ends_with(path, '/go.mod') OR ends_with(path, '/package.json') AS BIGINT) AS m, len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> '')) AS n FROM f) SELECT language, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(m) AS BIGINT) AS manifests FROM g WHERE language IS NOT NULL GROUP BY language")
def src_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.profile(tree(spark, sf_dir))


@query(f"SELECT {_nid('NATION', 'n_nationkey')} AS id FROM nation WHERE contains(n_name, '1')")
def q_find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.symbols(_traversal(spark, sf_dir)[0].filter("node_type = 'NATION'"), "1").select("id")


@query(f"SELECT {_nid('NATION', 'n_nationkey')} AS id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def q_find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _traversal(spark, sf_dir)
    return lookup.references(nodes, edges, "ASIA").select("id")


@query(f"SELECT {_nid('CUSTOMER', 'c_custkey')} AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 AND contains(c_name, '1')")
def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.evaluate(_traversal(spark, sf_dir)[0], "CUSTOMER", [("CONTAINS", "label", "1"), ("EQUALS", "file", "BUILDING"), ("EQUALS", "line", "7")]).select("id")


@query(f"SELECT 'type' AS key, count(*) AS n FROM supplier UNION ALL SELECT 'label', count(*) FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'file', count(*) FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'odd', 0")
def q_lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _traversal(spark, sf_dir)[0]
    asked = (("type", "SUPPLIER"), ("label", "ASIA"), ("file", "MACHINERY"), ("odd", 1))
    counts = [lookup.by_key(nodes, k, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("key"), "n") for k, v in asked]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
