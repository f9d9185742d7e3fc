"""Names, slices, phone numbers and tolerant JSON reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_text(*parts: Column) -> Column:
    """Join as text; NULL counts as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def null_if_blank(text: Column) -> Column:
    """Trimmed text, with blank text as NULL."""
    return F.nullif(F.btrim(text, F.lit(" \t\r\n\u00a0")), F.lit(""))


def snake_name(raw: Column) -> Column:
    """Lower-case name of letters, digits and single underscores; ``unnamed`` when nothing is left."""
    lowered = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    separated = F.regexp_replace(lowered, r"[ \-_]", "_")
    kept = F.regexp_replace(separated, r"[^\p{L}\p{N}_]", "")
    name = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")
    return F.when(name == "", "unnamed").otherwise(name)


def truncate_text(text: Column, limit: int, marker: str = "...") -> Column:
    """The first ``limit`` characters, with a marker when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))
    ).otherwise(text)


def left_of(text: Column, count: int = 1) -> Column:
    """The first characters; an empty cell gives an empty text."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(count))


def right_of(text: Column, count: int = 1) -> Column:
    return F.right(F.coalesce(text, F.lit("")), F.lit(count))


def middle_of(text: Column, start: int, count: int) -> Column:
    """``count`` characters from place ``start``, counted from 1."""
    return F.substring(F.coalesce(text, F.lit("")), start, count)


def shown_number(value: Column, decimals: int) -> Column:
    """A number as text with separators of thousands."""
    return F.format_number(value, decimals)


def phone_e164(text: Column, country: str = "1", national_digits: int = 10) -> Column:
    """``+`` and digits when the text can be read as a phone number, else NULL."""
    raw = F.trim(text)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    international = F.when(
        F.startswith(raw, F.lit("+")) & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits)
    )
    dialled = F.when(
        F.startswith(digits, F.lit("00")) & F.length(digits).between(10, 17),
        F.concat(F.lit("+"), F.substring(digits, 3, 15)),
    )
    national = F.when(F.length(digits) == national_digits, F.concat(F.lit(f"+{country}"), digits))
    prefixed = F.when(
        (F.length(digits) == national_digits + len(country)) & F.startswith(digits, F.lit(country)),
        F.concat(F.lit("+"), digits),
    )
    legal = ~raw.rlike(r"[^0-9+().\-\s]")
    return F.when(legal, F.coalesce(international, dialled, national, prefixed))


# A string literal, one that is never closed, or a bracket outside of strings.
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|"[^"\\]*+(?:\\.[^"\\]*+)*+\\?+$|[{}\[\]]'
_CONTROL = {chr(i): f"\\u{i:04x}" for i in range(32)} | {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _object_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def _tokens(text: Column, body) -> Column:
    """``body(pieces, tokens)``: the text between tokens, and the tokens; one more piece than tokens."""
    parts = F.struct(
        F.split(text, _TOKEN, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("tokens")
    )
    return F.element_at(F.transform(F.array(parts), lambda p: body(p["pieces"], p["tokens"])), 1)


def _escape_control(text: Column) -> Column:
    """Control characters inside string literals become escapes."""

    def escaped(token: Column) -> Column:
        out = token
        for raw, code in _CONTROL.items():
            out = F.replace(out, F.lit(raw), F.lit(code))
        return F.when(token.startswith('"') & token.rlike(r"[\x00-\x1f]"), out).otherwise(token)

    def joined(pieces: Column, tokens: Column) -> Column:
        fixed = F.concat(F.transform(tokens, escaped), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, fixed, lambda a, b: F.concat(a, b)), "")

    return _tokens(text, joined)


def _scan(text: Column) -> Column:
    """Struct of ``end``, the length of the first complete object (0 if none), and ``open``, the brackets left open.

    Braces inside strings do not count. An unclosed string leaves a quote on top of ``open``.
    """

    def walk(pieces: Column, tokens: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(tokens)), tokens, lambda p, t: F.struct(F.length(p).alias("p"), t.alias("t")))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("open"))

        def step(s: Column, x: Column) -> Column:
            token, at = x["t"], s["at"] + x["p"] + F.length(x["t"])
            unclosed = token.startswith('"') & ~token.rlike(r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"$')
            opened = F.when(token == "{", F.concat(F.lit("}"), s["open"])).when(token == "[", F.concat(F.lit("]"), s["open"]))
            opened = opened.when(token.isin("}", "]"), F.substring(s["open"], F.lit(2), F.length(s["open"])))
            opened = opened.when(unclosed, F.concat(F.lit('"'), s["open"])).otherwise(s["open"])
            closes = (token == "}") & (F.length(s["open"]) == 1) & (s["end"] == 0)
            return F.struct(at.alias("at"), F.when(closes, at).otherwise(s["end"]).alias("end"), opened.alias("open"))

        return F.aggregate(steps, start, step, lambda s: F.struct(s["end"].alias("end"), s["open"].alias("open")))

    return _tokens(text, walk)


def _closed(text: Column) -> Column:
    """The text from its first brace on, with what is still open closed in the right order."""
    body = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    return F.concat(body, _scan(body)["open"])


def _nested_object(depth: int) -> str:
    """Pattern of an object whose braces nest no deeper than ``depth``; possessive, so it never goes back."""
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    inner = f"|{_nested_object(depth - 1)}" if depth > 1 else ""
    return rf'\{{(?:[^{{}}"]++|{string}{inner})*+\}}'


_WHOLE = rf"(?s)\A{_nested_object(3)}\z"


def _is_one_object(text: Column) -> Column:
    """Whether the first object ends with the text: by one pattern, and by counting only where braces nest deeply."""
    return text.rlike(_WHOLE) | (_scan(text)["end"] == F.length(text))


def json_candidates(response: Column) -> list[Column]:
    """The texts to try, mildest repair first."""
    span = _object_span(response)
    commas = F.regexp_replace(span, r",\s*([}\]])", "$1")
    slashes = F.regexp_replace(commas, r'\\(?!["\\/bfnrtu])', r"\\\\")
    control = _escape_control(slashes)
    balanced = F.substring(control, F.lit(1), _scan(control)["end"])
    closed = _closed(_escape_control(response))
    innermost = F.regexp_extract(control, r"(\{[^{}]*\})", 1)
    return [span, commas, slashes, control, balanced, closed, innermost]


def json_repair(response: Column) -> Column:
    """Struct of the first readable text and the number of the attempt that read it (0 first).

    A text is readable when it is one JSON object from its first character to its last. Both fields are
    NULL when no attempt succeeds.
    """
    tries = [
        F.when(
            (c != "") & F.try_parse_json(c).isNotNull() & _is_one_object(c),
            F.struct(c.alias("json"), F.lit(i).alias("attempt")),
        )
        for i, c in enumerate(json_candidates(response))
    ]
    return F.coalesce(*tries)
