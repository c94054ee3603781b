"""Functions of what goes over the wire: JSON-RPC messages, headers, redaction, amounts, content decoding."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
FREE_METHODS = ["initialize", "notifications/initialized", "notifications/cancelled", "tools/list", "resources/list", "resources/templates/list", "prompts/list", "ping"]
PAID_EVIDENCE, PAID_WEATHER = ["research_evidence"], ["get-alerts", "get-forecast"]
SECRET_KEY = "(?i)(secret|token|password|passwd|authorization|cookie|api[_-]?key|private[_-]?key|signature)"
REDACTED, TOO_DEEP, MOST_DEPTH, MOST_ITEMS = "[redacted]", "[depth-limit]", 6, 100
TEXTUAL = ["text/html", "text/plain", "application/xhtml+xml", "application/json", "application/ld+json", "text/xml", "application/xml"]

#: Levels of lists that a response is looked through.
MOST_NESTED = 6


def _kind(v: Column) -> Column:
    """Type of a variant: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, VOID (a JSON null) and others; null for nothing."""
    return F.schema_of_variant(v)


def needs_payment(body: Column, paid: list[str]) -> Column:
    """Whether a JSON-RPC body must be paid for: if it, or any message of a batch, is not known to be free. What can't be
    read must be paid for."""

    def is_free(m: Column) -> Column:
        method, params = F.try_variant_get(m, "$.method", "string"), F.try_variant_get(m, "$.params", "variant")
        text = _kind(F.try_variant_get(m, "$.method", "variant")) == "STRING"
        called = (method == "tools/call") & _kind(params).rlike("^(OBJECT|ARRAY)")
        name = F.coalesce(F.try_variant_get(params, "$.name", "string"), F.lit("undefined"))
        return F.coalesce(_kind(m).startswith("OBJECT") & text & (method.isin(FREE_METHODS) | (called & ~name.isin(paid))), F.lit(False))

    v = F.try_parse_json(body)
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(_kind(v).startswith("ARRAY"), ~F.forall(many, is_free)).otherwise(~F.coalesce(is_free(v), F.lit(False)))


def response_failed(body: Column, content_type: Column) -> Column:
    """Whether a JSON-RPC response, plain or as an event stream, tells of a failed call: an error, or a result with isError
    true, alone or in a batch (batches within batches to a depth of MOST_NESTED). Text that is no JSON fails if it holds the
    marker."""

    def one(v: Column) -> Column:
        error, marked = F.try_variant_get(v, "$.error", "variant"), F.try_variant_get(v, "$.result.isError", "variant")
        found = F.coalesce(_kind(error) != "VOID", F.lit(False)) | F.coalesce((_kind(marked) == "BOOLEAN") & F.try_variant_get(marked, "$", "boolean"), F.lit(False))
        return F.coalesce(_kind(v).startswith("OBJECT") & found, F.lit(False))

    def opened(many: Column) -> Column:
        return F.flatten(F.transform(many, lambda v: F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))

    def failed(text: Column) -> Column:
        v = F.try_parse_json(text)
        many = F.array(v)
        for _ in range(MOST_NESTED):
            many = opened(many)
        return F.when(v.isNull(), text.rlike('"isError"\\s*:\\s*true')).otherwise(F.exists(many, one))

    text = F.trim(F.coalesce(body, F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_extract(x, "^data:\\s*(.*)$", 1)), lambda x: x != "")
    payloads = F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("event-stream"), lines).otherwise(F.array(text))
    return (text != "") & F.exists(payloads, failed)


def decode_header(value: Column) -> Column:
    """A base64 header that holds JSON, as JSON text; null if it is neither."""
    text = F.try_to_binary(value, F.lit("base64")).cast("string")
    return F.when(F.try_parse_json(text).isNotNull(), F.to_json(F.try_parse_json(text)))


def _redact(value, depth: int = 0):
    if depth > MOST_DEPTH:
        return TOO_DEEP
    if isinstance(value, list):
        return [_redact(v, depth + 1) for v in value[:MOST_ITEMS]]
    if isinstance(value, dict):
        return {k: REDACTED if re.search(SECRET_KEY, k) else _redact(v, depth + 1) for k, v in value.items()}
    return value


def _number(x: float) -> str:
    """A number as JSON writers of the web have it: 1e3 is 1000, 1.50 is 1.5, exponents only from 1e21 and below 1e-6; what is
    too large is null."""
    if abs(x) == float("inf"):
        return "null"
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        text = format(Decimal(repr(x)), "f").removesuffix(".0")
        return "0" if x == 0 else text
    mantissa, power = f"{Decimal(repr(x)).normalize():e}".split("e")
    return f"{mantissa}e{int(power):+d}"


def _written(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return _number(float(value))
    return json.dumps(value, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(name)


@F.pandas_udf(StringType())
def redact(texts: pd.Series) -> pd.Series:
    """JSON text with the values of secret-looking keys hidden, at any depth; null for text that is no JSON (NaN and Infinity
    are none). Numbers are doubles, as in the web's JSON."""

    def one(t):
        try:
            return _written(_redact(json.loads(t, parse_constant=_no_constant)))
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def content_encodings(header: Column) -> Column:
    """Tokens of a content-encoding header in order, without `identity` and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: ~t.isin("", "identity"))


def is_supported_type(content_type: Column) -> Column:
    """Whether the MIME type, up to `;`, is one that is read; false for null."""
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(TEXTUAL), F.lit(False))


def content_length(header: Column) -> Column:
    """A header of digits only, as a number up to 2**53 - 1, else null."""
    n = F.when(header.rlike("^[0-9]+$"), header.try_cast("bigint"))
    return F.when(n <= (1 << 53) - 1, n)


def too_large(size: Column, wire_size: Column, most: int, ratio: int = 200, floor: int = 64 * 1024) -> Column:
    """Why a decoded body must be refused: over `most` bytes, or over `floor` and more than `ratio` times its size on the wire."""
    return F.when(size > most, "response exceeded the maximum allowed size").when((size > floor) & (size > wire_size * ratio), "response expanded beyond the maximum allowed decompression ratio")


def agent_prefix(agent: Column) -> Column:
    """User agent without control characters, at most 60 characters; null if nothing is left."""
    x = F.substring(F.regexp_replace(F.coalesce(agent, F.lit("")), "[\\x00-\\x1f\\x7f]", ""), 1, 60)
    return F.when(x != "", x)


def client_key(connecting: Column, forwarded: Column, socket: Column) -> Column:
    """The connecting address, else the first forwarded one, else the socket's."""
    full = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(full(connecting), full(F.substring_index(forwarded, ",", 1)), socket)


def preview_ip(forwarded: Column, socket: Column) -> Column:
    return F.coalesce(client_key(F.lit(None).cast("string"), forwarded, F.lit(None).cast("string")), F.when(socket != "", socket), F.lit("unknown"))


def percent(n: Column, d: Column) -> Column:
    """One decimal and a percent sign; `n/a` for none of none."""
    return F.when(d == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", 100.0 * n / d), F.lit("%")))


def amount_usd(amount: Column) -> Column:
    """Dollars of an amount of millionths given as text; null for what is no number."""
    n = F.when(F.trim(amount) == "", F.lit(0.0)).otherwise(amount.try_cast("double"))
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n / 1e6)


def wallet_usd(hex_amount: Column) -> Column:
    """Dollars of a hexadecimal amount of millionths; 0 for what is none."""
    return F.coalesce(F.conv(F.regexp_extract(hex_amount, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("decimal(20,0)") / F.lit(1_000_000), F.lit(0)).cast("decimal(26,6)")


def budget(now: Column, base: Column, allowance: Column) -> Column:
    """spent and remaining of an allowance since a base amount."""
    spent = F.greatest(base - now, F.lit(0))
    return F.struct(spent.alias("spent"), (allowance - spent).alias("remaining"), (allowance - spent > 0).alias("inside"))


def fixed4(x: Column) -> Column:
    """A coordinate with four decimals."""
    return F.format_string("%.4f", x)


def expiry(stored_at: Column, ttl_seconds: Column) -> Column:
    return F.timestamp_add("SECOND", ttl_seconds, stored_at)


def since(now: Column, window: str) -> Column:
    """Start of a window such as `24h` or `7d` that ends now."""
    n, unit = int(window[:-1]), {"h": "HOUR", "d": "DAY", "m": "MINUTE"}[window[-1]]
    return F.timestamp_add(unit, F.lit(-n), now)


def to_iso(text: Column) -> Column:
    """A date and time as `yyyy-MM-ddTHH:mm:ss.SSSZ` in UTC; null for what can't be read."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
