"""Names, search keys, tokens and digests."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Generation suffixes that are no part of a name.
_SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def _without_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def without_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks (Spark has none). Texts of ASCII
    alone are as they are; only others are sent to Python."""
    return F.coalesce(pandas_udf(_without_marks, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def search_key(text: Column) -> Column:
    """Without marks, lower case, apostrophes gone, all but letters and digits as spaces,
    spaces squeezed."""
    bare = F.regexp_replace(F.lower(without_marks(text)), "['’]", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def _search_key(text: str) -> str:
    """``search_key`` of a query on the driver."""
    marked = unicodedata.normalize("NFKD", text)
    bare = "".join(c for c in marked if not unicodedata.combining(c)).lower().replace("'", "").replace("’", "")
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split())


def matches_search(query: str, *fields: Column) -> Column:
    """Whether a field's key contains the query's, or does once both lose their spaces."""
    key = _search_key(query)
    found = F.lit(False)
    for f in fields:
        k = F.coalesce(search_key(f), F.lit(""))
        found = found | k.contains(key) | F.replace(k, F.lit(" "), F.lit("")).contains(key.replace(" ", ""))
    return found


def person_name(text: Column) -> Column:
    """Lower-case a-z tokens, accents folded, without generation suffixes."""
    ascii_only = F.regexp_replace(without_marks(text), r"[^\x00-\x7f]+", "")
    tokens = F.regexp_extract_all(F.lower(ascii_only), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*_SUFFIXES)), " ")


def upper_tokens(text: Column, pattern: str = r"[/,;|]+") -> Column:
    """Distinct, trimmed, upper-case parts, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(text, pattern), lambda t: F.upper(F.trim(t))), lambda t: t != ""))


def bounded_key(text: Column, limit: int = 512) -> Column:
    """The text, or a digest of it beyond ``limit`` bytes."""
    return F.when(F.octet_length(text) > limit, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def distinct_keys(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``name``: the key, with ``#2``, ``#3`` and so on behind it where it repeats."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(name, F.when(n > 1, F.concat_ws("#", key, n.cast("string"))).otherwise(F.col(key)))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the row as JSON, columns in name order, nulls among them."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
