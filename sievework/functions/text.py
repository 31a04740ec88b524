"""Normalisation, identity and parsing of text values as Column expressions.

Only NFC and case folding, which Spark lacks, run as Arrow UDFs.
"""

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space by which words are split: what str.split() takes; fixed values.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode composition; nulls stay. Texts in ASCII, which are composed, never leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFC, full case folding and single spaces between words; null where no word is left."""
    return text.map(lambda x: " ".join(unicodedata.normalize("NFC", x).casefold().split()) or None, na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json_sha256(text: pd.Series) -> pd.Series:
    """SHA-256 of the document with sorted keys and no spaces; null where it isn't JSON or has NaN."""
    import hashlib

    def refuse(_: str) -> None:
        raise ValueError

    def one(raw: str) -> str | None:
        try:
            value = json.loads(raw, parse_constant=refuse)
        except ValueError:
            return None
        return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()

    return text.map(one, na_action="ignore")


def stripped(text: Column) -> Column:
    """Without white space at either end; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", ""), F.lit(""))


def required_text(text: Column) -> Column:
    """Line ends as newlines, NFC, stripped; null where empty."""
    return stripped(nfc(F.regexp_replace(text, "\r\n?", "\n")))


def plain_fingerprint(text: Column) -> Column:
    """Fingerprint in SQL functions only: lower-cased, single spaces, SHA-256. It differs from
    ``fingerprint`` where case folding or composition does more than lower-casing."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), "[ \t\r\n]+", " ")), 256)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text's case-folded words; null where it has none."""
    return F.sha2(folded(text), 256)


def strict_date(text: Column) -> Column:
    """``YYYY-MM-DD``, or the local calendar date of an ISO date-time; null for anything else."""
    text = F.trim(text)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    moment = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.coalesce(day, F.when(moment & F.try_to_timestamp(text).isNotNull(), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")))


def source_date(text: Column) -> Column:
    """An ISO date, or the date of an ISO date-time as it is written; null for anything else."""
    return strict_date(text)


def optional_text(text: Column) -> Column:
    """As ``required_text``; null is no fault here."""
    return required_text(text)


def confined(path: Column, prefix: str) -> Column:
    """Whether a relative path lies under a prefix and never climbs."""
    parts = F.split(path, "/")
    sound = ~path.startswith("/") & ~F.array_contains(parts, "..") & ~F.array_contains(parts, "") & ~path.contains("\\")
    return F.coalesce(sound & path.startswith(prefix.rstrip("/") + "/"), F.lit(False))


def json_valid(text: Column) -> Column:
    """Whether a text is JSON; NaN and Infinity are not."""
    return F.try_parse_json(text).isNotNull()


def json_field_type(payload: Column, name: str) -> Column:
    """The JSON type of a payload's field: null, boolean, integer, number, string, array or object."""
    return json_type(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))


def json_type(value: Column) -> Column:
    """The JSON type of a variant; SQL null where the field is missing."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def string_field(payload: Column, name: str) -> Column:
    """A payload's field where it is a JSON string, else null."""
    return F.when(json_field_type(payload, name) == "string", F.get_json_object(payload, f"$.{name}"))


def identifier_field(payload: Column, name: str) -> Column:
    """An id that is a JSON string or integer, as stripped NFC text; null for anything else."""
    return F.when(json_field_type(payload, name).isin("string", "integer"), stripped(nfc(F.get_json_object(payload, f"$.{name}"))))


def request_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of named fields."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def batch_id(retrieved_at: Column, artifact_sha256: Column, prefix: str = "batch") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(retrieved_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(artifact_sha256, 1, 12))


def run_id(at: Column, commit: Column, prefix: str = "run") -> Column:
    name = F.sha2(F.concat(utc_text(at), F.lit(":"), commit), 256)
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(name, 1, 12))


def utc_text(at: Column) -> Column:
    """ISO text with seconds and Z, in a session that keeps UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def url_accepted(url: Column, host: str, path_prefix: str = "/", scheme: str = "https") -> Column:
    """Whether a URL has exactly this scheme and host, a path under the prefix, and no user, port or fragment."""
    try_part = lambda part: F.try_parse_url(url, F.lit(part))
    authority = try_part("AUTHORITY")
    fits = (try_part("PROTOCOL") == scheme) & (try_part("HOST") == host) & (authority == host) & F.coalesce(try_part("PATH"), F.lit("/")).startswith(path_prefix)
    return F.coalesce(fits & try_part("REF").isNull(), F.lit(False))


def html_escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def content_sha256(content: Column, *, any_line_ends: bool = False) -> Column:
    """SHA-256 of bytes; with ``any_line_ends``, of the text with CRLF read as LF."""
    return F.sha2(F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n")) if any_line_ends else content, 256)


def short_label(label: Column, names: dict[str, str]) -> Column:
    """A label's short name, or the label itself."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[label], label) if pairs else label
