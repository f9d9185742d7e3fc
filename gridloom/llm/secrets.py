"""Secrets in text: fixed patterns, and long tokens that pass a battery of randomness tests.

Fixed patterns find keyword assignments, access keys and long hex runs. For every other token of 20 or more
key-like characters an encoding is inferred from the characters it uses, which gives an alphabet of k
symbols, and three tests look at the symbols' places in that alphabet:

* chi-squared uniformity. Language uses few symbols often, which adds about ``n * (k * COINCIDENCE - 1)`` to
  the statistic; the p-value is the chance that a language-like token of n characters looks as even as
  this one (normal approximation of the non-central distribution, so it depends on the length). Of hex
  tokens the test says little at usual key lengths, so the changes between digits and letters count as
  well: the p-value is the chance that a plain token, which changes at a place with chance ``CHANGE``, has as
  many (Chernoff's bound), and both are put together by Fisher's rule;
* runs above and below the middle of the alphabet, and
* correlation of neighbours; both must agree with a random string at ``LEVEL``.

The Benjamini-Hochberg rule at rate ``FDR`` then runs over all distinct tokens of the corpus, apart for each
encoding and length band, on exact counts per p-value bin, so that short tokens do not ride on long ones.

All work is DataFrame expressions; one pass reads the texts, and only hashes of tokens and bin counts are shuffled.
Positions are code points, ends exclusive. Defined cases: NULL texts count as empty and have no spans; repeated
tokens and rows are judged alike and count as one test; texts of any length are scanned whole; an empty table gives no rows; an input column named like an
output column is replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import let, tidy
from gridloom.session import cut_lineage

# Fixed patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"(?i:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings in the order in which they are tried: name, pattern, alphabet.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/-_"),
)
HEX_NUMBER = 1
#: Chance that two characters of a language-like token agree.
COINCIDENCE = 0.075
#: Chance that a plain hex token changes between digits and letters at a place.
CHANGE = 0.15
LEVEL_Z = 3.29  # two-sided 0.001
LEVEL = 0.001
FDR = 0.01
#: p-value bins per power of ten, and the last bin.
BINS, LAST_BIN = 20, 600

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,stratum:int,bin:int,token:bigint>>"


def _places(text: Column, pattern: str) -> Column:
    """Array of ``start, end, match`` of the leftmost non-overlapping matches, which are never empty."""

    def walk(pieces: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        lengths = F.zip_with(
            F.slice(pieces, 1, F.size(pieces) - 1), found, lambda p, m: F.struct(F.char_length(p).alias("p"), m.alias("m"))
        )
        none = F.array().cast("array<struct<start:int,end:int,match:string>>")
        return F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["p"] + F.char_length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["p"]).alias("start"),
                    (acc["at"] + x["p"] + F.char_length(x["m"])).alias("end"),
                    x["m"].alias("match"),
                ))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return let(F.split(text, pattern, -1), walk)


def _spans(text: Column, kind: int, pattern: str, likely: Column, keep=None) -> Column:
    places = _places(text, pattern)
    if keep is not None:
        places = F.filter(places, keep)
    spans = F.transform(places, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))
    return F.when(likely, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three fixed patterns; a cheap look decides which texts are searched at all."""

    def long_enough(x: Column) -> Column:
        return F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST

    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return {
        "assign": _spans(text, 0, ASSIGN, sign & text.rlike(KEYWORD), long_enough),
        "access": _spans(text, 1, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": _spans(text, 2, HEX, text.rlike(HEX)),
    }


def _normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, logistic form, absolute error below 2e-4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.07056)))


def _changing(values: Column, places: Column) -> Column:
    """p-value of the changes between digits and letters of a hex token with so many places between symbols."""
    letter = F.transform(values, lambda x: x >= 10)
    changes = F.aggregate(
        F.zip_with(F.slice(letter, 1, places), F.slice(letter, 2, places), lambda a, b: (a != b).cast("int")),
        F.lit(0), lambda a, x: a + x,
    )

    def bound(share: Column) -> Column:
        # The limit of x * ln(x) is 0; the least double stands in for 0.
        rest = F.greatest(1 - share, F.lit(1e-300))
        return F.when(share <= CHANGE, 1.0).otherwise(
            F.exp(-places * (share * F.log(share / CHANGE) + rest * F.log(rest / (1 - CHANGE))))
        )

    return let(changes / places, bound)


def _encoding(body: Column) -> Column:
    number = F.when(body.rlike(ENCODINGS[0][1]), 0)
    for i, (_, pattern, _) in enumerate(ENCODINGS[1:-1], start=1):
        number = number.when(body.rlike(pattern), i)
    return number.otherwise(len(ENCODINGS) - 1)


def _tested(place: Column) -> Column:
    """``start, end, stratum, bin, token`` of one token; the bin is NULL when runs or neighbours are not random."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def with_values(t: Column) -> Column:
        k, n = F.char_length(t["alphabet"]), F.size(t["v"])
        counts = F.transform(
            F.sequence(F.lit(0), k - 1),
            lambda s: (n - F.size(F.filter(t["v"], lambda x: x != s))).cast("double"),
        )
        even = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
        extra = n * F.greatest(k * COINCIDENCE - 1, F.lit(0.5))
        z = (even - (k - 1 + extra)) / F.sqrt(2 * (k - 1 + 2 * extra))
        both = F.greatest(_normal_cdf(z) * _changing(t["v"], n - 1), F.lit(1e-300))
        p = F.when(t["encoding"] == HEX_NUMBER, let(both, lambda x: x * (1 - F.log(x)))).otherwise(_normal_cdf(z))

        high = F.transform(t["v"], lambda x: (2 * x >= k).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
        n2 = n - n1
        runs = F.lit(1) + F.aggregate(
            F.zip_with(F.slice(high, 1, n - 1), F.slice(high, 2, n - 1), lambda a, b: (a != b).cast("int")),
            F.lit(0), lambda a, x: a + x,
        )
        mean_runs = 1 + 2 * n1 * n2 / n
        spread = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(spread > 0, (runs - mean_runs) / F.sqrt(spread))

        mean = F.aggregate(t["v"], F.lit(0.0), lambda a, x: a + x) / n
        square = F.aggregate(t["v"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        beside = F.aggregate(
            F.zip_with(F.slice(t["v"], 1, n - 1), F.slice(t["v"], 2, n - 1), lambda a, b: (a - mean) * (b - mean)),
            F.lit(0.0), lambda a, x: a + x,
        )
        z_beside = F.when(square > 0, (beside / square + 1.0 / n) * F.sqrt(n))
        random = F.coalesce((F.abs(z_runs) <= LEVEL_Z) & (F.abs(z_beside) <= LEVEL_Z), F.lit(False))
        step = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS), F.lit(LAST_BIN)).cast("int")
        band = F.floor(F.log2(n.cast("double"))).cast("int")
        return F.struct(
            place["start"].alias("start"), place["end"].alias("end"),
            (t["encoding"] * 100 + band).alias("stratum"), F.when(random, step).alias("bin"),
            F.xxhash64(place["match"]).alias("token"),
        )

    def with_encoding(t: Column) -> Column:
        alphabet = F.get(alphabets, t["encoding"])
        same_case = F.when((t["encoding"] == HEX_NUMBER) | (t["encoding"] == 5), F.lower(t["body"])).otherwise(t["body"])
        values = F.transform(F.split(same_case, ""), lambda c: F.instr(alphabet, c) - 1)
        return let(
            F.struct(t["encoding"].alias("encoding"), alphabet.alias("alphabet"),
                     F.filter(values, lambda x: x >= 0).alias("v")),
            with_values,
        )

    body = F.rtrim(place["match"], F.lit("="))
    return let(F.struct(body.alias("body"), _encoding(body).alias("encoding")), with_encoding)


def candidates(text: Column) -> Column:
    """Tested tokens of a text."""
    tested = F.transform(_places(text, TOKEN), _tested)
    return F.when(text.rlike(TOKEN), tested.cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def _levels(found: DataFrame, rate: float) -> dict[int, int]:
    """Smallest bin to be called random, per stratum, by the Benjamini-Hochberg rule on exact counts.

    The result has one entry per encoding and power of two of the length at most.
    """
    tokens = found.select(F.explode("_candidates").alias("c")).select("c.stratum", "c.bin", "c.token").distinct()
    counts = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    counts = counts.groupBy("stratum", F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.sum("n").alias("n"))
    by = Window.partitionBy("stratum")
    upto = F.sum("n").over(by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    tests = F.sum("n").over(by)
    passing = counts.select("stratum", "bin", (tests * F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * upto).alias("ok"))
    levels = passing.filter("ok AND bin >= 0").groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in levels.collect()}


def find_secrets(docs: DataFrame, rate: float = FDR, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept input columns and ``secrets``: array of ``start, kind, end`` ordered by start, then kind.

    ``kind`` is a place in ``KINDS``. A random token is left out where a fixed pattern's span touches it.
    """
    rows = tidy(docs, taken=("secrets", "_base", "_candidates", "_text"))
    kept = list(keep) if keep is not None else rows.columns
    text = F.col("_text")
    rows = rows.select(*kept, F.coalesce("text", F.lit("")).alias("_text"))
    found = rows.select(*kept, F.sort_array(F.concat(*base_spans(text).values())).alias("_base"),
                        candidates(text).alias("_candidates"))
    found = cut_lineage(found, "secret-candidates")
    levels = _levels(found, rate)
    if levels:
        level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
        random = F.filter("_candidates", lambda c: F.coalesce(c["bin"] >= F.element_at(level, c["stratum"]), F.lit(False)))
        random = F.filter(random, lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        added = F.transform(random, lambda c: F.struct(c["start"], F.lit(3).alias("kind"), c["end"])).cast(_SPAN)
        secrets = F.sort_array(F.concat("_base", added))
    else:
        secrets = F.col("_base")
    return found.select(*kept, secrets.alias("secrets"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]", rate: float = FDR) -> DataFrame:
    """The input rows with every span replaced by ``mark``; overlapping spans are replaced as one."""
    found = find_secrets(docs, rate)

    def masked(text: Column, spans: Column) -> Column:
        done = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.when(s["end"] <= acc["at"], acc).when(
                s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))
            ).otherwise(F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
            )),
        )
        return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text))))

    return found.withColumn("text", masked(F.col("text"), F.col("secrets"))).drop("secrets")
