"""Joins by similarity and by pattern against tables, without trying all pairs.

Both build an inverted index of character grams as DataFrames: what can match meets in an equality join, and only
those pairs are verified.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.similarity import FUZZY_THRESHOLD, indel_ratio
from gridloom.session import cut_lineage, per_key

#: Marks in front of and behind a name, so that its first and last letter have grams of their own.
_EDGES = ("\u0002", "\u0003")


def _grams(text: Column) -> Column:
    """Two-letter grams with the number of their occurrence: a bag as a set."""
    padded = F.concat(F.lit(_EDGES[0]), text, F.lit(_EDGES[1]))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    numbered = lambda g, i: F.struct(
        g.alias("gram"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda other: other == g)).alias("nth")
    )
    return F.transform(grams, numbered)


def _shared(total: Column, threshold: float) -> Column:
    """How many grams two names of ``total`` letters share at least if they reach the threshold.

    They differ by d <= total (1 - threshold / 100) insertions and deletions; a deletion takes two grams from the
    longer name's bag and an insertion one, so (letters + 1) - (3 d + difference in length) / 2 stay.
    """
    # A hair more, so that rounding never makes the bound stricter.
    edits = F.floor(total * (100 - threshold) / 100 + 1e-9)
    return F.greatest(F.lit(1), F.ceil(total / 2 + 1 - edits * 1.5)).cast("int")


def _mask(grams: Column, half: int) -> Column:
    """64 bits of a bag: every gram sets one, so what one bag has and the other lacks shows."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(F.lit(half), g).bitwiseAND(63).cast("int"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda held, g: held.bitwiseOR(bit(g)))


def _entries(names: DataFrame, order: DataFrame, threshold: float, own: str, other: str, keep: str) -> DataFrame:
    """Index entries of each name: its rarest grams, as many as must hold one in common, per length of a partner."""
    size = F.char_length(keep)
    spread = names.select(keep, F.explode(_grams(F.col(keep))).alias("g"))
    # A gram that no name of the dictionary has is the rarest of all.
    ranked = spread.join(order, "g", "left").groupBy(keep).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "g"))), lambda x: x["g"]
        ).alias("_grams")
    )
    ranked = ranked.withColumns({f"{own}{half}": _mask(F.col("_grams"), half) for half in range(2)})
    low = F.ceil(size * threshold / (200 - threshold) - 1e-9).cast("int")
    high = F.floor(size * (200 - threshold) / threshold + 1e-9).cast("int")
    per_length = ranked.withColumn(own, size).withColumn(other, F.explode(F.sequence(low, high)))
    length = size + 1 - _shared(F.col(own) + F.col(other), threshold) + 1
    return per_length.select(keep, own, other, f"{own}0", f"{own}1", F.explode(F.slice("_grams", F.lit(1), F.greatest(F.lit(1), length))).alias("g"))


def _lacking(a: str, b: str) -> Column:
    """At least so many grams of ``a`` that ``b`` does not have: the half of the bits that shows more."""
    halves = [F.bit_count(F.col(f"{a}{h}").bitwiseAND(F.bitwise_not(F.col(f"{b}{h}")))) for h in range(2)]
    return F.greatest(*halves)


@F.pandas_udf(T.DoubleType())
def _ratio(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(a, b) for a, b in zip(one, two)], dtype="float64")


def similar_pairs(names: DataFrame, dictionary: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """``name, word, score`` of all pairs of a name and a dictionary word that reach the threshold.

    Both tables are taken as sets of non-empty texts. The similarity is 200 times the longest common subsequence
    over the summed lengths. Rare grams come first in every entry, so a gram that most words share is looked up
    only by names that have little else. Works above a threshold of 2/3.
    """
    if not math.isfinite(threshold) or not 200 / 3 < threshold <= 100:
        raise ValueError("the gram bound needs a threshold above 66.7")
    asked = names.select("name").filter("name <> ''").distinct()
    words = cut_lineage(dictionary.select("word").filter("word <> ''").distinct(), "words")
    order = per_key(words.select(F.explode(_grams(F.col("word"))).alias("g")).groupBy("g").agg(F.count("*").alias("seen")))
    left = _entries(asked, order, threshold, "m", "n", "name")
    right = _entries(words, order, threshold, "n", "m", "word")
    enough = _shared(F.col("m") + F.col("n"), threshold)
    near = (F.col("m") + 1 - _lacking("m", "n") >= enough) & (F.col("n") + 1 - _lacking("n", "m") >= enough)
    met = left.join(right, ["m", "n", "g"]).filter(near).select("name", "word").distinct()
    return met.withColumn("score", _ratio("name", "word")).filter(F.col("score") >= threshold)


def match_dictionary(names: DataFrame, dictionary: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """For each distinct ``name`` its ``canonical, score, exact`` from a table of ``position, own, canonical, word``.

    A word equal to the name wins at once, the first by position; else the highest score, and among equals the first
    by ``position, own``. Canonical names themselves (``own`` 0) count for equality only. Names without a match are
    left out.
    """
    place = F.struct("position", "own")
    same = dictionary.groupBy(F.col("word").alias("name")).agg(F.min_by("canonical", place).alias("canonical"))
    asked = cut_lineage(names.select("name").filter("name <> ''").distinct(), "names")
    same = per_key(same)
    exact = asked.join(same, "name").select("name", "canonical", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))
    rest = asked.join(same.select("name"), "name", "left_anti")
    listed = dictionary.filter("own > 0")
    best = F.struct("score", (-F.col("position")).alias("p"), (-F.col("own")).alias("o"))
    near = similar_pairs(rest, listed, threshold).join(listed, "word").groupBy("name").agg(
        F.max_by("canonical", best).alias("canonical"), F.max("score").alias("score")
    )
    return exact.unionByName(near.withColumn("exact", F.lit(False)))


#: Letters of a gram by which patterns and texts meet.
GRAM = 3
#: Result rows that one group of equal texts may bring to a task.
GROUP_ROWS = 1 << 22
#: Stand for escaped characters while a pattern is taken apart.
_STAND = {"\\\\": "\ufdd0", "\\%": "\ufdd1", "\\_": "\ufdd2"}


def _literals(pattern: Column) -> Column:
    """The runs of a LIKE pattern without wildcards."""
    for escaped, stand in _STAND.items():
        pattern = F.replace(pattern, F.lit(escaped), F.lit(stand))
    back = lambda run: F.translate(run, "".join(_STAND.values()), "\\%_")
    return F.filter(F.transform(F.split(pattern, "[%_]"), back), lambda run: run != "")


def _runs(text: Column, size: Column) -> Column:
    """Distinct grams of ``size`` letters; none for a shorter text."""
    last = F.char_length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array())


def _anchors(patterns: DataFrame) -> DataFrame:
    """Possible anchors of each pattern: grams of its longest literals, or its length, or nothing at all."""
    runs = _literals(F.col("pattern"))
    longest = F.least(F.coalesce(F.array_max(F.transform("_runs", lambda r: F.char_length(r))), F.lit(0)), F.lit(GRAM))
    # Written with its literals: a filter that Spark derives from the grams would spell them out again for every row.
    known = cut_lineage(patterns.select("pattern").distinct().withColumn("_runs", runs).withColumn("_n", longest), "patterns")
    grams = F.array_distinct(F.flatten(F.transform("_runs", lambda r: _runs(r, F.col("_n")))))
    # Without a literal only the length can tell: exactly so many letters, or any text.
    fixed = ~F.contains("pattern", F.lit("%"))
    other = F.when(fixed, F.array(F.char_length("pattern").cast("string"))).otherwise(F.array(F.lit("")))
    size = F.when(F.col("_n") > 0, F.col("_n")).when(fixed, -1).otherwise(0)
    ways = known.withColumn("size", size).withColumn("_grams", F.when(F.col("_n") > 0, grams).otherwise(other))
    return ways.select("pattern", "size", F.explode("_grams").alias("gram"))


def _met(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Texts beside the anchors that they hold."""
    text = F.col("text")
    ways = [F.struct(F.lit(0).alias("size"), F.array(F.lit("")).alias("grams")),
            F.struct(F.lit(-1).alias("size"), F.array(F.char_length(text).cast("string")).alias("grams"))]
    ways += [F.struct(F.lit(n).alias("size"), _runs(text, F.lit(n)).alias("grams")) for n in range(1, GRAM + 1)]
    # At most GRAM + 2 sizes; those that no pattern uses are not spelt out.
    sizes = [r["size"] for r in anchors.select("size").distinct().collect()]
    spread = texts.select("text", F.explode(F.filter(F.array(*ways), lambda w: w["size"].isin(sizes))).alias("w"))
    spread = spread.select("text", "w.size", F.explode("w.grams").alias("gram"))
    return spread.join(anchors, ["size", "gram"])


def pattern_table_join(df: DataFrame, name: Column, patterns: DataFrame) -> DataFrame:
    """Rows of ``df`` with the columns of each row of ``patterns`` whose LIKE ``pattern`` their name matches.

    Every pattern is keyed by the gram of its literals that the fewest texts hold, texts meet it by that gram, and
    only then the whole pattern is tested. Equal texts are tested once. NULL matches nothing; ``\\`` escapes.
    """
    anchors = cut_lineage(_anchors(patterns.filter("pattern IS NOT NULL")), "anchors")
    texts = cut_lineage(df.select(name.alias("text")).filter("text IS NOT NULL").distinct(), "texts")
    used = per_key(anchors.select("size", "gram").distinct())
    held = per_key(_met(texts, used).groupBy("size", "gram").agg(F.count("*").alias("texts")))
    # A gram that no text holds rules its pattern out at once.
    ranked = anchors.join(held, ["size", "gram"], "left").groupBy("pattern").agg(
        F.min_by(F.struct("size", "gram"), F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("a"),
        F.min(F.coalesce("texts", F.lit(0))).alias("texts"),
    )
    chosen = per_key(ranked.filter("texts > 0").select("pattern", "a.size", "a.gram"))
    found = _met(texts, chosen).filter(F.expr("text LIKE pattern")).select("text", "pattern")
    matches = cut_lineage(found, "matches").withColumnRenamed("text", "_text")
    meeting = cut_lineage(matches.join(patterns, "pattern"), "meeting")
    # Written, so that the numbers of the rows stay the same whenever they are read.
    marked = cut_lineage(df.withColumn("_text", name).filter(F.col("_text").isNotNull()), "marked")
    return _spread_join(marked, meeting)


def _spread_join(rows: DataFrame, meeting: DataFrame) -> DataFrame:
    """Both tables joined by ``_text``, a text whose result is large being dealt over several tasks.

    The result may be much larger than either table, which Spark sees too late to split it, so it is counted first.
    """
    sizes = rows.groupBy("_text").agg(F.count("*").alias("_n")).join(meeting.groupBy("_text").agg(F.count("*").alias("_m")), "_text")
    groups = F.col("_n").cast("double") * F.col("_m") / GROUP_ROWS
    dealt = per_key(sizes.select("_text", F.ceil(groups).cast("int").alias("_parts"), groups.alias("_groups")))
    full = dealt.agg(F.ceil(F.sum("_groups")).alias("n")).first()["n"] or 0
    # A given number of partitions is not merged again for being small.
    tasks = max(int(full), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.drop("_groups")
    part = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")
    left = rows.join(dealt, "_text").withColumn("_part", part).drop("_parts")
    right = meeting.join(dealt, "_text").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    keys = ["_text", "_part"]
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).drop(*keys)
