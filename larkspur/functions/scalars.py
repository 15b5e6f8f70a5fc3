"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAMESPACE = "default"


def effective_namespace(namespace: Column, client_default: Column | None = None) -> Column:
    """The namespace of a request, else the client's, else ``default``; empty counts as unset."""
    own = F.nullif(namespace, F.lit(""))
    rest = F.nullif(client_default, F.lit("")) if client_default is not None else F.lit(None)
    return F.coalesce(own, rest, F.lit(DEFAULT_NAMESPACE))


def queue_state_key(queue: Column, message_id: Column) -> Column:
    """Key of the state that is bound to a message; null if queue or message is empty."""
    filled = (F.length(queue) > 0) & (F.length(message_id) > 0)
    return F.when(filled, F.format_string("q/%s/state/%s", queue, message_id))


def endpoint(url: Column) -> Column:
    """A service address without slashes at its end."""
    return F.regexp_replace(url, "/+$", "")


def safe_token(name: Column) -> Column:
    """Letters, digits and ``-_.``; any other run becomes one ``-``, and none at the edges."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")


def url_encoded(text: Column) -> Column:
    """Percent-encoding in which only unreserved characters stand for themselves."""
    form = F.url_encode(text)
    for raw, coded in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(raw), F.lit(coded))
    return form


def int64(text: Column) -> Column:
    """A whole signed 64-bit number in base 10 with no blanks around it; else null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def uint64(text: Column) -> Column:
    """A whole number from 0 to 2^64 - 1; else null."""
    value = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value.cast("decimal(20,0)"))


def base64(data: Column) -> Column:
    """Base64 in one line, whatever the session says about line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def is_clean_text(data: Column) -> Column:
    """Whether bytes are UTF-8 without NUL."""
    as_text = data.cast("string")
    return F.is_valid_utf8(as_text) & ~as_text.contains("\0")


def text_or_base64(data: Column) -> Column:
    """Bytes as text where they are clean text, else in base64."""
    return F.when(is_clean_text(data), data.cast("string")).otherwise(base64(data))
