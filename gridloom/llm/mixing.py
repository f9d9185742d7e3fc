"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget; whole epochs of the source come first, and what is left of the budget is
a fractional epoch: documents in ascending order of -ln(u) / quality, a weighted sample without
replacement, each taken if it fits into what is left. One more document, the one whose size fits the
remaining gap best, is added where that brings the source nearer to its budget; a source still more than one
percent off takes its smallest document left out and gives others back for it.

Ranks, prefix sums and budgets are distributed: a source that holds a third of all rows is spread over
range chunks, and only one row per source is ever joined back.

Defined cases: NULL and empty texts have size 0 and come with whole epochs only; NULL sources form one source,
ranked last; ties in the key are broken by doc_id and then by the row's position, so repeated rows are separate
members; texts of any length are counted whole; an empty table gives no rows; an input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import tidy, uniform, word_count
from gridloom.operators.ordered import running_number, running_sum
from gridloom.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 7
#: Share of a target that may be missing before documents are exchanged.
TOLERANCE = 0.01
NOISE = "#*$%&|<>!{}[]^~0123456789"
OUT = ("size", "source_size", "target", "epochs", "picked", "taken")
_SOURCE = ["_src", "_none"]


def quality_weight(text: Column) -> Column:
    """Share of characters that are not symbols or digits, between 0.05 and 1."""
    text = F.coalesce(text, F.lit(""))
    clean = F.char_length(F.translate(text, NOISE, "")) / F.greatest(F.char_length(text), F.lit(1))
    return F.greatest(clean, F.lit(0.05))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (``_src, _none, source_size``) in; adds ``target``.

    The k-th source by code point (NULL last) has weight ``weights[k % len]``. Targets share the total of
    all sizes by weight; a target above ``most`` times its source's size stops there and the excess goes
    to the others by weight until none is above. With sources in the order of size per weight, the capped
    ones are a prefix, so two running sums give the result without iteration.
    """
    ranked = running_number(sources, [], [F.col("_none"), F.col("_src")], "_rank", start=0)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights)).cast("int") + 1).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    order = [F.col("_cap") / F.col("_w"), F.col("_rank")]
    sums = running_sum(ranked, [], order, F.col("_cap"), "_caps")
    sums = cut_lineage(running_sum(sums, [], order, F.col("_w"), "_ws"), "mix-sources")
    total = sums.agg(F.sum("source_size").alias("t"), F.sum("_w").alias("w")).first()
    if not total["t"]:
        return sums.withColumn("target", F.lit(0.0))
    # What is left per unit of weight when this source's turn comes, all before it being capped.
    rate = (F.lit(total["t"]) - F.col("_caps") + F.col("_cap")) / (F.lit(total["w"]) - F.col("_ws") + F.col("_w"))
    free = sums.withColumn("_rate", rate).filter(F.col("_cap") > F.col("_rate") * F.col("_w"))
    level = free.agg(F.min_by("_rate", F.struct("_ws", "_rank")).alias("r")).first()["r"]
    share = F.col("_cap").cast("double") if level is None else F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w"))
    return sums.withColumn("target", share)


_PLACE = ("_key", "doc_id", "_pos")


def _inside(passes: str = "_passes", sign: int = 1) -> Column:
    """Whether a row was taken by one of its source's passes: in the pass's stretch and not too large for it."""
    place = F.struct((F.col("_key") * sign).alias("_key"), "doc_id", "_pos")
    return F.exists(passes, lambda p: (F.col("size") <= p["most"]) & (p["after"].isNull() | (place > p["after"])) & (place <= p["upto"]))


def _filled(slim: DataFrame, budget: DataFrame) -> DataFrame:
    """Add to each source's row, which has a budget ``_left``, the words taken ``_got`` and the passes that take them.

    In the order of the keys each document is taken that fits into what is left of the budget. A pass sums up the
    documents not larger than what is left; it ends at the first one that overshoots, which by then fits no more, so
    the next pass goes on behind it with the smaller ones. What is left shrinks with every pass to less than the
    document that ended it, so few passes are needed; a source is done when nothing that fits is left behind.
    """
    order, place = [F.col(c) for c in _PLACE], F.struct(*_PLACE)
    spot = dict(slim.select(place.alias("p")).dtypes)["p"]
    state = cut_lineage(budget.withColumns({
        "_got": F.lit(0).cast("long"), "_after": F.lit(None).cast(spot),
        "_passes": F.array().cast(f"array<struct<most:double,after:{spot},upto:{spot}>>"),
    }), "mix-budgets")
    while True:
        room = F.col("_left") - F.col("_got")
        open_rows = slim.join(state.select(*_SOURCE, "_left", "_got", "_after"), _SOURCE).filter(
            (F.col("size") > 0) & (F.col("size") <= room) & (F.col("_after").isNull() | (place > F.col("_after")))
        )
        summed = running_sum(open_rows, _SOURCE, order, F.col("size"), "_upto")
        taken = summed.filter(F.col("_upto") + F.col("_got") <= F.col("_left")).groupBy(*_SOURCE).agg(
            F.max(place).alias("_end"), F.max("_upto").alias("_more")
        )
        # One row per source that still takes something.
        taken = cut_lineage(taken, "mix-pass")
        if taken.isEmpty():
            return state.drop("_after")
        step = F.struct(room.alias("most"), F.col("_after").alias("after"), F.col("_end").alias("upto"))
        state = cut_lineage(state.join(taken, _SOURCE, "left").withColumns({
            "_passes": F.when(F.col("_end").isNotNull(), F.array_append("_passes", step)).otherwise(F.col("_passes")),
            "_got": F.col("_got") + F.coalesce("_more", F.lit(0)), "_after": F.coalesce("_end", "_after"),
        }).drop("_end", "_more"), "mix-cuts")


def _cuts(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole epochs, the passes of the fractional epoch, and what mends the gap that they leave.

    That is the document not taken that fills the gap best, if taking it is better than leaving the gap. Where still
    more than ``TOLERANCE`` of the target is missing, the smallest document not taken comes in and others go for
    it, the last ones first, as long as they fit into its excess; this is done where it brings the source nearer.
    """
    place = F.struct(*_PLACE)
    budget = targets.select(
        *_SOURCE, "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("_left", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = _filled(slim, budget)
    gap = F.col("_left") - F.col("_got")
    off = F.abs(F.col("size") - gap)
    outside = slim.join(state.select(*_SOURCE, "_left", "_got", "_passes"), _SOURCE).filter((F.col("size") > 0) & ~_inside())
    ends = outside.groupBy(*_SOURCE).agg(
        F.min(F.when(off < gap, F.struct(off.alias("off"), place.alias("p")))).alias("_best"),
        F.min(F.struct("size", place.alias("p"))).alias("_least"),
    )
    state = state.join(ends, _SOURCE, "left").withColumn("_miss", F.coalesce(F.col("_best.off"), gap))
    state = cut_lineage(state, "mix-gaps")
    short = state.filter((F.col("_miss") > TOLERANCE * F.col("target")) & F.col("_least").isNotNull())
    owed = short.select(*_SOURCE, (F.col("_least.size") - gap).alias("_left"))
    inside = slim.join(short.select(*_SOURCE, "_passes"), _SOURCE).filter(_inside()).drop("_passes")
    back = _filled(inside.withColumn("_key", -F.col("_key")), owed).select(
        *_SOURCE, F.col("_passes").alias("_back"), (F.col("_left") - F.col("_got")).alias("_over")
    )
    better = F.coalesce(F.col("_over") < F.col("_miss"), F.lit(False))
    decided = state.join(back, _SOURCE, "left").withColumns({
        "_extra": F.when(better, F.col("_least.p")).otherwise(F.col("_best.p")), "_back": F.when(better, F.col("_back")),
    })
    return cut_lineage(decided.drop("_left", "_got", "_best", "_least", "_miss", "_over"), "mix-decisions")


def mix_sources(
    docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_EPOCHS, seed: int = SEED,
    quality: Column | None = None, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row with ``size, source_size, target, epochs, picked, taken`` (words taken, repeats counted).

    ``keep`` names the input columns to return (all by default); the row is written once with its position
    so that the sample is decided on, and applied to, the same rows.
    """
    rows = tidy(docs, ("doc_id", "text", "source"), OUT)
    text = F.col("text")
    weight = quality_weight(text) if quality is None else quality
    kept = list(dict.fromkeys(["doc_id", *(keep if keep is not None else rows.columns)]))
    marked = rows.select(
        *kept,
        word_count(text).alias("size"),
        (-F.log(uniform(F.lit(seed), F.col("doc_id"))) / weight).alias("_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_src"),
        F.col("source").isNull().alias("_none"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    marked = cut_lineage(marked, "mix-rows")
    slim = marked.select("doc_id", "size", "_key", "_pos", *_SOURCE)
    sources = slim.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    targets = source_targets(cut_lineage(sources, "mix-sizes"), weights, most)
    gone = F.coalesce(_inside("_back", -1), F.lit(False))
    picked = (_inside() & ~gone) | F.coalesce(F.struct(*_PLACE) == F.col("_extra"), F.lit(False))
    mixed = marked.join(_cuts(slim, targets), _SOURCE).withColumn("picked", F.coalesce(picked, F.lit(False)))
    return mixed.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).drop(
        "_key", "_pos", "_passes", "_back", "_extra", *_SOURCE
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every input row as often as it is taken, with the input's columns."""
    names = tidy(docs, ("doc_id", "text", "source"), OUT).columns
    mixed = mix_sources(docs, **options)
    times = (F.col("epochs") + F.col("picked").cast("long")).cast("int")
    return mixed.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*names)
