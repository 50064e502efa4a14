"""Text functions as column expressions: tokens, chunks, redaction, secrets and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_'-]+"
#: Keys whose values are secret, and how such a pair stands in text.
SECRET_KEYS = ("auth_token", "auth_token_hash", "secret", "password", "jwt", "api_key", "database_url", "token")
SECRET = r"(?i)(auth_token|secret|password|jwt|api_key|token|database_url)\s*[:=]\s*['\"]?([^\s'\";,]+)['\"]?"
#: What tells of an environment variable, a provider of secrets, a path.
FROM_ENVIRONMENT = r"(?i)\b(env|getenv|os\.getenv|os\.environ|process\.env)\b"
FROM_PROVIDER = r"(?i)\b(config|Secret::|Vault::|secrets_manager|key_vault|aws_secrets|Vault|SecretsManager)\b"
PATH_NAME = r"(?i)\b(storage_path|database_path|base_path|app_path|resource_path|path\.join|Path)\b"


def tokens(column: str) -> Column:
    """Lower-cased ASCII words; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def chunked(df: DataFrame, id_col: str, column: str, size: int) -> DataFrame:
    """id, chunk and tokens: consecutive runs of at most size tokens."""
    own = df.select(id_col, tokens(column).alias("t")).filter(F.size("t") > 0)
    last = F.floor((F.size("t") - 1) / size).cast("int")
    return own.select(id_col, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(id_col, "chunk", F.slice("t", F.col("chunk") * size + 1, F.lit(size)).alias("tokens"))


def redact(column: str) -> Column:
    """Values of secret keys in a text give way to a mark; quotes and the separator go with them."""
    return F.regexp_replace(F.col(column), SECRET, "$1=[REDACTED]")


def redact_map(column: str) -> Column:
    """Of a map from text to text: values of secret keys as a whole, secrets in others; keys in any case."""
    hide = lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), F.lit("[REDACTED]")).otherwise(F.regexp_replace(v, SECRET, "$1=[REDACTED]"))
    return F.transform_values(F.col(column), hide)


def value_kind(text: Column) -> Column:
    """What a piece of code gives as a value: the part after =>, else after =, else after a colon, else all of it."""
    t = F.trim(text)
    after = lambda mark: F.trim(F.substr(t, F.locate(mark, t) + len(mark)))
    has = lambda mark: F.contains(t, F.lit(mark))
    v = F.when(has("=>"), after("=>")).when(has("=") & ~t.rlike("^(if|while)"), after("=")).when(has(":") & ~t.rlike("^case"), after(":")).otherwise(t)
    quoted = v.rlike(r"(?s)^'.+'$") | v.rlike(r'(?s)^".+"$')
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "EMPTY_LITERAL")
        .when(v.rlike(FROM_ENVIRONMENT), "ENV_REFERENCE")
        .when(v.rlike(FROM_PROVIDER), "SECRET_PROVIDER_REFERENCE")
        .when(v.rlike(PATH_NAME), "STATIC_CONSTANT")
        .when(v.isin("", "''", '""', "b''", 'b""'), "EMPTY_LITERAL")
        .when(F.lower(v).isin("null", "none", "undefined"), "NULL_LITERAL")
        .when(quoted, "LITERAL_SECRET")
        .otherwise("UNKNOWN")
    )


def secrets(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, place, key and kind of the value of every pair in a text that looks like a secret."""
    pairs = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(SECRET), F.lit(0))
    own = df.select(id_col, F.posexplode(pairs).alias("place", "pair"))
    return own.select(id_col, "place", F.lower(F.regexp_extract("pair", SECRET, 1)).alias("key"), value_kind(F.col("pair")).alias("kind"))


def url_host(column: str) -> Column:
    return F.lower(F.regexp_extract(column, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_parts(column: str) -> list[Column]:
    scheme = F.lower(F.regexp_extract(column, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return [scheme.alias("scheme"), url_host(column).alias("host"), F.regexp_extract(column, "^[^?#]*?://[^/?#]*([^?#]*)", 1).alias("path")]


def url_zone(column: str) -> Column:
    h = url_host(column)
    return (
        F.when(h.isin("169.254.169.254", "metadata.google.internal"), "METADATA")
        .when(h.rlike(r"^kubernetes(\.default|$)"), "KUBERNETES")
        .when((h == "localhost") | h.startswith("127."), "LOOPBACK")
        .when(h.startswith("169.254."), "LINK_LOCAL")
        .when(h.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), "PRIVATE")
        .when(h == "", "INVALID")
        .otherwise("PUBLIC")
    )
