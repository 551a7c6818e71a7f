"""Offer identity, digests and the URL policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from promoforge.functions.text import normalized


def identity(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 over the ``|`` joined parts.

    An absent part contributes ``None``; pass booleans through :func:`flag_text`.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 32)


def flag_text(flag: Column) -> Column:
    """Boolean as ``True``, ``False`` or ``None``."""
    return F.when(flag, "True").when(~flag, "False").otherwise("None")


def instant_text(instant: Column) -> Column:
    """UTC instant in ISO form with offset, seconds precision unless there are micros."""
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def terms_digest(terms: Column) -> Column:
    """Digest of normalised terms: any wording change gives another one."""
    return F.sha2(normalized(terms), 256)


def record_digest(record: Column) -> Column:
    """Digest of a record's JSON form with all fields written, nulls included."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


# Scheme, user info, host, port, path and fragment of an absolute URL.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?[^#]*)?(#.*)?$"


def url_parts(url: Column) -> dict[str, Column]:
    return {
        "scheme": F.lower(F.regexp_extract(url, _URL, 1)),
        "user": F.regexp_extract(url, _URL, 2),
        "host": F.lower(F.regexp_extract(url, _URL, 3)),
        "port": F.regexp_extract(url, _URL, 4),
        "path": F.regexp_extract(url, _URL, 5),
        "fragment": F.regexp_replace(F.regexp_extract(url, _URL, 6), "^#", ""),
    }


def url_allowed(url: Column, hosts: Column, allow_fragment: bool = True) -> Column:
    """https, a listed host, no user info, default port, and (on request) no fragment."""
    p = url_parts(url)
    allowed = (
        (p["scheme"] == "https")
        & F.array_contains(hosts, p["host"])
        & (p["user"] == "")
        & p["port"].isin("", "443")
    )
    if not allow_fragment:
        allowed = allowed & (p["fragment"] == "")
    return F.coalesce(allowed, F.lit(False))
