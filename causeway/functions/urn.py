"""Dataset names: namespaces, URNs and the table names inside them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that count as white space around a field.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Schemes that different tools use for the same system.
SCHEME_ALIASES = {"postgres": "postgresql", "s3a": "s3", "s3n": "s3"}

# File extensions that are not a table name.
FILE_EXTENSIONS = ("parquet", "csv", "json", "avro", "orc")

# Up to the last "@" (kept), host, then the last ":..." of the host (dropped).
# The first group is possessive so that a host without a port never matches earlier text.
_HOST_PORT = r"(?s)\A((?>.*@)?+)([^/?]*):[^:/?]*(?=[/?]|\z)"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_namespace(namespace: Column) -> Column:
    """Lower-case and unify the scheme and drop the port; names without ``://`` stay as they are."""
    scheme = F.lower(F.regexp_extract(namespace, r"(?s)\A(.*?)://", 1))
    for alias, target in SCHEME_ALIASES.items():
        scheme = F.regexp_replace(scheme, rf"\A{alias}\z", target)
    rest = F.regexp_replace(F.regexp_replace(namespace, r"(?s)\A.*?://", ""), _HOST_PORT, "$1$2")
    return F.when(F.contains(namespace, F.lit("://")), F.concat(scheme, F.lit("://"), rest)).otherwise(namespace)


def dataset_urn(namespace: Column, name: Column) -> Column:
    return F.concat(normalize_namespace(namespace), F.lit("/"), name)


# Namespace and name: split at the first "/" after the protocol, or at the first "/" without one.
_URN = r"(?s)\A(.*?://[^/]*|(?!.*://)[^/]*)/(.*)\z"


def urn_namespace(urn: Column) -> Column:
    return F.regexp_extract(urn, _URN, 1)


def urn_name(urn: Column) -> Column:
    return F.regexp_extract(urn, _URN, 2)


def urn_error(urn: Column) -> Column:
    return (
        F.when(~urn.rlike(_URN), "missing_delimiter")
        .when(urn.startswith("/"), "empty_namespace")
        .when(urn_name(urn) == "", "empty_name")
        .when(urn_name(urn) == "/", "empty_name_after_delimiter")
    )


def parse_urn(urn: Column) -> Column:
    """struct<namespace, name, error>; the parts are null when ``error`` is set."""
    error = urn_error(urn)
    return F.struct(
        F.when(error.isNull(), urn_namespace(urn)).alias("namespace"),
        F.when(error.isNull(), urn_name(urn)).alias("name"),
        error.alias("error"),
    )


def normalize_urn(urn: Column) -> Column:
    """struct<urn, error>: the trimmed URN, or why it is not one."""
    text = trimmed(urn)
    error = urn_error(text)
    return F.struct(F.when(error.isNull(), text).alias("urn"), error.alias("error"))


def table_name(urn: Column) -> Column:
    """The bare table name of a URN in lower case, for matching across tools."""
    scheme_at = F.locate("://", urn)
    path = F.when(scheme_at > 0, urn.substr(scheme_at + 3, F.length(urn))).otherwise(urn)
    leaf = F.substring_index(path, "/", -1)
    extensions = "|".join(FILE_EXTENSIONS)
    stem = F.regexp_replace(leaf, rf"(?i)\.({extensions})\z", "")
    return F.lower(F.substring_index(stem, ".", -1))


def display_name(urn: Column) -> Column:
    """``schema.table`` after the last slash, else the last non-empty path segment."""
    schema_table = F.regexp_extract(urn, r"/([^/]+\.[^/]+)\z", 1)
    segments = F.filter(F.split(urn, "/", -1), lambda part: part != "")
    return F.coalesce(F.nullif(schema_table, F.lit("")), F.try_element_at(segments, F.lit(-1)), urn)
