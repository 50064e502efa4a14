"""Source trees as tables: which files to read, what they are, and what a project holds.

Files: path (relative to the root, with slashes) and content. The driver lists
the tree, as names only; every rule is a condition on the path, and executors
open what is left.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are not read, and hidden folders that are.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", ".venv", "venv", ".pytest_cache", "__pycache__", "build", "dist", ".gemini", "node_modules", "vendor")
SHOWN_FOLDERS = (".github", ".vscode", ".devcontainer")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock")
#: Endings and names of files that can be read.
ENDINGS = (".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".php", ".inc", ".phtml", ".go", ".rs", ".java", ".yaml", ".yml", ".json", ".dockerfile", ".tf", ".tfvars")
NAMES = ("dockerfile", "containerfile")
#: The language of an ending, and of a manifest.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".php": "PHP", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".go": "Go",
    ".rs": "Rust", ".java": "Java", ".c": "C", ".cpp": "C++", ".h": "C/C++ Header", ".cs": "C#", ".html": "HTML", ".htm": "HTML", ".rb": "Ruby",
}
MANIFESTS = {
    "package.json": "JavaScript/TypeScript", "composer.json": "PHP", "requirements.txt": "Python", "pyproject.toml": "Python", "pipfile": "Python", "setup.py": "Python", "go.mod": "Go", "cargo.toml": "Rust", "pom.xml": "Java", "build.gradle": "Java",
}
#: Kind, format and certainty of source files by their ending.
SOURCES = {".py": "PYTHON", ".js": "JAVASCRIPT", ".jsx": "JAVASCRIPT", ".ts": "TYPESCRIPT", ".tsx": "TYPESCRIPT", ".go": "GO", ".php": "PHP", ".rs": "RUST", ".java": "JAVA"}


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and uri of every file below root. Spark's own listing leaves out names that begin with a dot or underscore, and empty files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    where = top.getFileSystem(conf)
    start = where.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    found, rows = where.listFiles(top, True), []
    while found.hasNext():
        at = found.next().getPath()
        rows.append((at.toUri().getPath().removeprefix(start), at.toUri().toString()))
    return spark.createDataFrame(rows, "path string, uri string")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        texts = []
        for uri in pdf["uri"]:
            where, path = fs.FileSystem.from_uri(uri)
            with where.open_input_stream(path) as f:
                texts.append(f.read().decode("utf-8", "replace"))
        yield pd.DataFrame({"path": pdf["path"], "content": texts})


def read(spark: SparkSession, root: str, skip: Iterable[str] = (), ignore: Iterable[tuple[str, bool]] = ()) -> DataFrame:
    """path and content of the files below root that are to be read, in order of path; only these are opened."""
    own = candidates(listed(spark, root), skip, ignore)
    return own.mapInPandas(_contents, "path string, content string").orderBy("path")


def name(path: str = "path") -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def ending(path: str = "path") -> Column:
    """The last dot of the name and what follows, in lower case; a dot that begins the name begins no ending."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def readable(path: str = "path") -> Column:
    return name(path).isin(*NAMES) | name(path).startswith("dockerfile.") | ending(path).isin(*ENDINGS)


def like(column: Column, pattern: str) -> Column:
    """Whether a shell pattern fits the whole value, without regard to slashes."""
    return column.rlike("^" + fnmatch.translate(pattern).removesuffix("\\Z") + r"\z")


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: like(x, pattern)


def ignored(patterns: Iterable[tuple[str, bool]], path: str = "path") -> Column:
    """Patterns (text, negated) of ignore files: the first that fits decides; with a slash it is about the path, else about any part."""
    parts = F.split(path, "/")
    out = F.lit(False)
    for text, negated in reversed([(t.rstrip("/"), n) for t, n in patterns]):
        if text:
            fits = like(F.col(path), text.removeprefix("**/")) if "/" in text else F.exists(parts, _like(text))
            out = F.when(fits, F.lit(not negated)).otherwise(out)
    return out


def ignore_patterns(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """Patterns of an ignore file's lines; comments and empty lines are none, and ! negates."""
    kept = [x.strip() for x in lines]
    return [(x.removeprefix("!").rstrip("/"), x.startswith("!")) for x in kept if x and not x.startswith("#")]


def candidates(files: DataFrame, skip: Iterable[str] = (), ignore: Iterable[tuple[str, bool]] = ()) -> DataFrame:
    """Files that are to be read: no skipped or hidden folder, lock file, generated or ignored file, and of a readable kind."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.isin(*SKIPPED_FOLDERS) | (x.startswith(".") & ~x.isin(*SHOWN_FOLDERS, ".gitignore")))
    out = hidden | name().isin(*LOCK_FILES) | name().endswith(".generated.py") | (ending() == ".pyc")
    for text in (t.strip() for t in skip):
        if text:
            out = out | F.array_contains(parts, text) | like(F.element_at(parts, -1), text) | (like(F.col("path"), text) if "/" in text else F.lit(False))
    return files.filter(~out & ~ignored(ignore) & readable())


def language(path: str = "path") -> Column:
    """The language of a file by its ending, else by its name as a manifest; null if neither is known."""
    of = lambda c, values: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])
    return F.coalesce(of(ending(path), LANGUAGES), of(name(path), MANIFESTS))


def target(path: str = "path", content: str = "content") -> Column:
    """kind, format and confidence of a file, by name, path and content."""
    n, e, text = name(path), ending(path), F.coalesce(F.col(content), F.lit(""))
    yaml = e.isin(".yaml", ".yml")
    made = lambda kind, fmt, sure: F.struct(F.lit(kind).alias("kind"), F.lit(fmt).alias("format"), F.lit(sure).alias("confidence"))
    has = lambda *words: F.contains(text, F.lit(words[0])) & F.contains(text, F.lit(words[1]))
    out = F.when((n == "dockerfile") | n.startswith("dockerfile.") | (e == ".dockerfile") | (n == "containerfile"), made("IAC", "DOCKERFILE", 1.0))
    out = out.when(F.contains(F.col(path), F.lit(".github/workflows")), made("PIPELINE", "GITHUB_ACTIONS", 0.95))
    out = out.when(yaml & has("on:", "jobs:"), made("PIPELINE", "GITHUB_ACTIONS", 0.85)).when(yaml & has("apiVersion:", "kind:"), made("MANIFEST", "KUBERNETES", 0.90))
    out = out.when(yaml & (F.contains(F.col(path), F.lit("templates/")) | (n == "values.yaml")), made("MANIFEST", "HELM", 0.80)).when(yaml, made("MANIFEST", "KUBERNETES", 0.60))
    out = out.when(e.isin(".tf", ".tfvars"), made("IAC", "TERRAFORM", 0.95))
    for x, fmt in SOURCES.items():
        out = out.when(e == x, made("SOURCE_CODE", fmt, 0.90))
    return out


def profile(files: DataFrame) -> DataFrame:
    """Of each language: files, lines that are not blank, and manifests among them."""
    lines = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    own = files.select(language().alias("language"), lines.alias("n"), name().isin(*MANIFESTS).cast("long").alias("manifest")).filter("language IS NOT NULL")
    return own.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"), F.sum("manifest").alias("manifests"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """case_id, rule_id, file_path, line, expected of a manifest in CSV with a header, or JSON lines; missing columns are null."""
    raw = spark.read.option("header", "true").csv(path) if path.endswith(".csv") else spark.read.json(path)
    kinds = {"case_id": "string", "rule_id": "string", "file_path": "string", "line": "long", "expected": "string"}
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
