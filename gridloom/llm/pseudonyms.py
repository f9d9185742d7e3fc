"""Format-preserving pseudonyms for personal data.

Phone, card and social security numbers, IPv4 addresses and numeric dates are validated and replaced by another
valid value of the same format. The replacement is a keyed permutation of all valid values of that format
(a Feistel network over the product of two residue classes, so that no value outside the format ever
arises), hence equal values get equal pseudonyms in every document, different values different ones,
and whoever holds the key can go back. E-mail addresses have no such finite format: their names are replaced
by keyed hashes, equal for equal addresses regardless of letter case, and keep the top-level domain.

Digits of other values may stand beside a card or phone number ('4111 1111 1111 1111 123'). Where a stretch of
digit groups is no card as a whole, it is read group by group: date, social security number or phone, else the
longest card that starts there. Every value found is permuted once and within its own format, so it has the same
pseudonym there as anywhere else. Read again, such a stretch may seem to hold other values; ``restore`` therefore
goes by the recorded places of the pseudonyms and does not read the text.

What fails validation (a card number with a wrong check digit, an impossible date, an octet above 255) is no
personal number and stays as it is. One expression per row, no shuffle. The key is a literal of the plan,
so event logs must be guarded like the key itself.

Defined cases: NULL texts stay NULL; texts without personal data come back byte for byte; texts of any length are
read whole, in one row's expressions; repeated rows are treated alike; an empty table gives no rows; an input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, tidy

KEY = "change-this-key"
ROUNDS = 10
DATE_FROM = "1900-01-01"
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DATE_SPACE = (17, 4297)
KINDS = ("email", "ipv4", "date", "ssn", "phone", "card")

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}"
_IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_DATE = r"(?<!\d)(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = (
    r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)"
)
#: Where a value of another format begins; a stretch of digit groups ends before it.
_OTHER = (
    r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{4}\.\d{2}\.\d{2}|\d{4}/\d{2}/\d{2}"
    r"|\d{3}\.\d{3}[ .-]\d{4}|\d{3}[ -]\d{3}\.\d{4})(?!\d)|[\p{L}\p{N}._%+-]++@"
)
#: 13 digits or more in groups; cards are looked for in it.
_STRETCH = rf"(?<!\d)(?=(?:\d[ -]?){{12}}\d)\d++(?:[ -](?!{_OTHER})\d++)*+"
_GROUPED = r"^\d[\d -]{12,}$"
#: Most digits of a card, and so most groups.
_CARD_MOST = 19
#: Addresses first, then the longest formats, so that a card is not read as a phone number.
_NUMBERS = "|".join((_IPV4, _DATE, _SSN, _STRETCH, _PHONE))
ANY = f"{_EMAIL}|{_NUMBERS}"
LIKELY = r"\d[\d ()./-]{5,}\d|@"


def permute(value: Column, a, b, key: str, tweak: Column | str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1 (longs): even rounds move the high part, odd rounds the low part."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)
    sign = -1 if back else 1
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def draw(r: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        high = F.when(r % 2 == 0, F.pmod(s["h"] + sign * (draw(r, s["l"]) % a), a)).otherwise(s["h"])
        low = F.when(r % 2 == 1, F.pmod(s["l"] + sign * (draw(r, s["h"]) % b), b)).otherwise(s["l"])
        return F.struct(high.alias("h"), low.alias("l"))

    # Integer division: doubles would lose digits of long card numbers.
    start = F.struct(F.call_function("div", value, b).alias("h"), F.pmod(value, b).alias("l"))
    return F.aggregate(F.array(*[F.lit(r) for r in order]), start, step, lambda s: s["h"] * b + s["l"])


def _permute_digits(digits: Column, key: str, tweak: str, back: bool) -> Column:
    """Permute all digit strings of the same length; at most 17 digits."""
    n = F.char_length(digits)
    low = F.pow(F.lit(10.0), F.floor(n / 2)).cast("long")
    high = F.pow(F.lit(10.0), n - F.floor(n / 2)).cast("long")
    name = F.concat_ws(":", F.lit(tweak), n.cast("string"))
    return F.lpad(permute(digits.cast("long"), high, low, key, name, back).cast("string"), n, "0")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule, the last digit counting once."""
    values = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")))
    return F.aggregate(
        F.transform(values, lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))),
        F.lit(0), lambda s, x: s + x,
    )


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(
            c.rlike(r"^\d$"),
            F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out")),
        ).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"],
    )


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _ipv4(m: Column, key: str, back: bool) -> Column:
    value = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permute(value, 65536, 65536, key, "ipv4", back)
    return let(new, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _date_parts(d: Column) -> tuple[Column, Column]:
    """The ISO form of a numeric date's digits, and whether the year comes first."""
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)), F.concat_ws(
        "-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)
    )


def _to_day(m: Column, d: Column) -> Column:
    year_first, year_last = _date_parts(d)
    iso = F.when(m.rlike(r"^\d{4}"), year_first).otherwise(year_last)
    day = F.datediff(iso.try_cast("date"), F.lit(DATE_FROM).cast("date"))
    return F.when((day >= 0) & (day < DATE_SPACE[0] * DATE_SPACE[1]), day)


def _date(m: Column, d: Column, key: str, back: bool) -> Column:
    new = permute(_to_day(m, d).cast("long"), *DATE_SPACE, key, "date", back).cast("int")
    day = F.date_add(F.lit(DATE_FROM).cast("date"), new)
    return _fill(m, F.when(m.rlike(r"^\d{4}"), F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "ddMMyyyy")))


def _ssn(m: Column, d: Column, key: str, back: bool) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area = F.substring(d, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    rank = (area * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    new = permute(rank, 898 * 99, 9999, key, "ssn", back)

    def digits(v: Column) -> Column:
        number = ((v - F.pmod(v, F.lit(99 * 9999))) / (99 * 9999)).cast("long") + 1
        number = number + F.when(number >= 666, 1).otherwise(0)
        group = F.pmod(((v - F.pmod(v, F.lit(9999))) / 9999).cast("long"), F.lit(99)) + 1
        return F.concat(*[F.lpad(x.cast("string"), w, "0") for x, w in ((number, 3), (group, 2), (F.pmod(v, F.lit(9999)) + 1, 4))])

    return _fill(m, let(new, digits))


def _american(m: Column, d: Column) -> Column:
    """Ten digits, or eleven after +1, with area and exchange from 200."""
    return d.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$") & (
        (F.char_length(d) == 10) & ~m.startswith("+") | (F.char_length(d) == 11) & m.startswith("+1")
    )


def _phone(m: Column, d: Column, key: str, back: bool) -> Column:
    def american() -> Column:
        ten = F.right(d, F.lit(10))
        rank = ((F.substring(ten, 1, 3).cast("long") - 200) * 800 + F.substring(ten, 4, 3).cast("long") - 200) * 10000 + F.right(
            ten, F.lit(4)
        ).cast("long")
        new = permute(rank, 80000, 80000, key, "phone-us", back)
        return let(new, lambda v: F.concat(
            F.lpad((((v - F.pmod(v, F.lit(8000000))) / 8000000).cast("long") + 200).cast("string"), 3, "0"),
            F.lpad((F.pmod(((v - F.pmod(v, F.lit(10000))) / 10000).cast("long"), F.lit(800)) + 200).cast("string"), 3, "0"),
            F.lpad(F.pmod(v, F.lit(10000)).cast("string"), 4, "0"),
        ))

    lead = F.char_length(d) - 10
    us = F.concat(F.when(lead > 0, F.lit("1")).otherwise(F.lit("")), american())
    # Elsewhere the first two digits, the country's, stay.
    other = F.concat(F.substring(d, 1, 2), _permute_digits(F.substring(d, F.lit(3), F.char_length(d)), key, "phone", back))
    return _fill(m, F.when(_american(m, d), us).otherwise(other))


def _card(m: Column, d: Column, key: str, back: bool) -> Column:
    """The first digit names the network and stays, the last one is the check digit."""
    n = F.char_length(d)
    body = F.concat(F.substring(d, 1, 1), _permute_digits(F.substring(d, F.lit(2), n - 2), key, "card", back))
    return _fill(m, let(body, lambda x: F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))))


def _hash(value: Column, key: str, length: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)).cast("binary"), 256), 1, length)


def _email(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    return F.concat(
        F.lit("u"), _hash(m, key, 12), F.lit("@d"), _hash(domain, key, 8), F.lit("."), F.substring_index(domain, ".", -1)
    )


def _kind(m: Column, d: Column) -> Column:
    """Place in ``KINDS`` of a valid match, else NULL."""
    n = F.char_length(d)
    octets = F.forall(_octets(m), lambda x: x.between(0, 255)) & ~m.rlike(r"(^|\.)0\d")
    return (
        F.when(m.contains("@"), 0)
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, 1))
        .when(m.rlike(r"^(\d{4}([-/.])\d{2}\2\d{2}|\d{2}([-/.])\d{2}\3\d{4})$"), F.when(_to_day(m, d).isNotNull(), 2))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"), 3))
        .when(m.rlike(r"^\d[\d -]+$") & n.between(13, 19) & (F.pmod(_luhn(d), F.lit(10)) == 0) & ~d.rlike(r"^(\d)\1+$"), 5)
        .when(m.startswith("+") & n.between(8, 15), 4)
        .when((n == 10) & _american(m, d), 4)
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _renewed(m: Column, kind: Column, key: str, back: bool) -> Column:
    """``m`` with its pseudonym for its place in ``KINDS``; as it is for any other number."""
    mail = m if back else _email(m, key)
    return let(_digits(m), lambda d: (
        F.when(kind == 0, mail).when(kind == 1, _ipv4(m, key, back)).when(kind == 2, _date(m, d, key, back))
        .when(kind == 3, _ssn(m, d, key, back)).when(kind == 4, _phone(m, d, key, back))
        .when(kind == 5, _card(m, d, key, back)).otherwise(m)
    ))


_PARTS = "array<struct<kind:int,s:string>>"


def _read(stretch: Column) -> Column:
    """A stretch of digit groups in parts ``kind, s``, one after the other; kind -1 is no personal number."""

    def parts(t: Column) -> Column:
        def joined(at: Column, groups) -> Column:
            return F.array_join(F.slice(t, at, 2 * groups - 1), "")

        def three(at: Column) -> Column:
            """Kind of the three groups from there; a social security number must not be part of more hyphens."""
            x, n = joined(at, F.lit(3)), F.size(t)
            free = (at > 1) & (F.get(t, at - 2) != "-") & ((at + 4 >= n) | (F.get(t, at + 4) != "-"))
            fits = x.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4}|\d{3}[ -]\d{3}[ -]\d{4})$") | (x.rlike(r"^\d{3}-\d{2}-\d{4}$") & free)
            return F.when(fits, F.coalesce(_kind(x, _digits(x)), F.lit(-1))).otherwise(-1)

        def card(at: Column) -> Column:
            """Number of groups of the longest card from there, 0 without one."""
            most = F.least(F.call_function("div", F.size(t) - at, F.lit(2)).cast("int") + 1, F.lit(_CARD_MOST))

            def valid(groups: Column) -> Column:
                return let(joined(at, groups), lambda x: F.when(
                    F.char_length(_digits(x)).between(13, _CARD_MOST), F.coalesce(_kind(x, _digits(x)) == 5, F.lit(False))
                ).otherwise(False))

            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), most), valid)), F.lit(0))

        def step(s: Column, at: Column) -> Column:
            def added(kind: Column, groups: Column) -> Column:
                part = F.struct(kind.cast("int").alias("kind"), joined(at, groups).alias("s"))
                return F.struct(
                    (at + 2 * groups - 1).cast("int").alias("next"), F.concat(s["parts"], F.array(part).cast(_PARTS)).alias("parts")
                )

            def chosen(c: Column) -> Column:
                return F.when(c["k"] >= 0, added(c["k"], F.lit(3))).when(c["n"] > 0, added(F.lit(5), c["n"])).otherwise(
                    added(F.lit(-1), F.lit(1))
                )

            is_group = F.element_at(t, at).rlike(r"^\d")
            found = F.struct(three(at).alias("k"), card(at).alias("n"))
            return F.when(at < s["next"], s).when(is_group, let(found, chosen)).otherwise(added(F.lit(-1), F.lit(1)))

        start = F.struct(F.lit(1).alias("next"), F.array().cast(_PARTS).alias("parts"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), start, step, lambda s: s["parts"])

    return let(F.regexp_extract_all(stretch, F.lit(r"\d+|\D"), F.lit(0)), parts)


def _stretch(m: Column, key: str) -> Column:
    """``kind, old, new`` of the parts of a stretch that is no number as a whole."""
    return F.transform(_read(m), lambda x: F.struct(
        F.when(x["kind"] >= 0, x["kind"]).alias("kind"), x["s"].alias("old"), _renewed(x["s"], x["kind"], key, False).alias("new")
    ))


_SEGMENTS = "array<struct<kind:int,old:string,new:string>>"


def _replaced(m: Column, key: str) -> Column:
    """Segments ``kind, old, new`` of a match; the kind is NULL where nothing is replaced."""

    def by_kind(k: Column) -> Column:
        one = F.array(F.struct(k.cast("int").alias("kind"), m.alias("old"), _renewed(m, k, key, False).alias("new")))
        apart = k.isNull() & m.rlike(_GROUPED)
        return F.when(apart, _stretch(m, key).cast(_SEGMENTS)).otherwise(one.cast(_SEGMENTS))

    return let(_kind(m, _digits(m)), by_kind)


def restore(rows: DataFrame, key: str = KEY) -> DataFrame:
    """The rows of :func:`pseudonymise` with their old ``text``, but for the e-mail hashes, which stay.

    ``personal`` says where the pseudonyms stand; it is dropped, with ``n_personal``. Rows without it stay as they are.
    """
    names, text = F.array(*[F.lit(k) for k in KINDS]), F.col("text")
    ends = F.concat(F.array(F.lit(0)), F.transform("personal", lambda p: p["end"]))

    def rebuilt(ends: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            before = F.get(ends, i)
            kind = F.array_position(names, p["kind"]).cast("int") - 1
            old = _renewed(F.substring(text, p["start"] + 1, p["end"] - p["start"]), kind, key, True)
            return F.concat(F.substring(text, before + 1, p["start"] - before), old)

        rest = F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform("personal", piece), ""), rest)

    return rows.withColumn("text", F.coalesce(let(ends, rebuilt), text)).drop("personal", "n_personal")


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The input rows with ``text`` rewritten, ``n_personal`` and ``personal``.

    ``personal`` lists ``kind, start, end, pseudonym`` of every replaced value in the order of the text;
    positions are code points of the new text, ends exclusive. With them :func:`restore` goes back.
    """
    rows = tidy(docs, taken=("n_personal", "personal", "_p"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.col("text")

    def rebuilt(parts: Column) -> Column:
        spans = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"

        def step(s: Column, x: Column) -> Column:
            end = s["at"] + F.char_length(x["new"])
            one = F.struct(F.get(names, x["kind"]).alias("kind"), s["at"].alias("start"), end.alias("end"), x["new"].alias("pseudonym"))
            found = F.when(x["kind"].isNotNull(), F.array(one)).otherwise(F.array()).cast(spans)
            return F.struct(end.alias("at"), F.concat(s["found"], found).alias("found"))

        def plain(p: Column) -> Column:
            return F.array(F.struct(F.lit(None).cast("int").alias("kind"), p.alias("old"), p.alias("new"))).cast(_SEGMENTS)

        between = F.slice(parts["p"], 1, F.size(parts["m"]))
        segments = F.flatten(F.zip_with(between, parts["m"], lambda p, m: F.concat(plain(p), m)))
        found = F.aggregate(
            segments, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("found")), step, lambda s: s["found"]
        )
        new = F.concat(F.array_join(F.transform(segments, lambda x: x["new"]), ""), F.element_at(parts["p"], -1))
        return F.struct(new.alias("text"), found.alias("personal"))

    pieces = F.split(text, ANY, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replaced(m, key))
    changed = let(F.struct(pieces.alias("p"), matches.alias("m")), rebuilt)
    none = F.struct(text.alias("text"), F.array().cast("array<struct<kind:string,start:int,end:int,pseudonym:string>>").alias("personal"))
    done = rows.withColumn("_p", F.when(text.rlike(LIKELY), changed).otherwise(none))
    return done.withColumns({
        "text": F.col("_p.text"), "n_personal": F.size("_p.personal").cast("long"), "personal": F.col("_p.personal"),
    }).drop("_p")
