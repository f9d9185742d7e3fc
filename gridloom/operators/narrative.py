"""Notes and meetings: sections, speakers, action items and extracted records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import json_repair
from gridloom.operators.ordered import carry_last

# Headings that open a section of notes.
HEADINGS = ("DECISIONS", "ACTION ITEMS", "OPEN QUESTIONS")
_BULLET = r"^\s*[-*•]\s+"
_NAME = r"[A-Z][\p{L}.'-]*(?: [A-Z][\p{L}.'-]*)?"
# Words a deadline may consist of.
_WHEN = r"(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|today|tomorrow|end of (?:day|week|month|quarter)|next (?:week|month)|\d{4}-\d{2}-\d{2})"


def section_lines(lines: DataFrame, key: str, order: str = "line_no", text: str = "text") -> DataFrame:
    """Bullets with the heading they stand under: ``key, order, section, item``."""
    heading = F.upper(F.regexp_extract(text, rf"(?i)^\s*({'|'.join(HEADINGS)})\s*:\s*$", 1))
    under = carry_last(lines, [key], [F.col(order)], F.nullif(heading, F.lit("")), "section")
    bullets = under.filter(F.col(text).rlike(_BULLET) & F.col("section").isNotNull())
    return bullets.select(key, order, "section", F.trim(F.regexp_replace(text, _BULLET, "")).alias("item"))


def speaker_turns(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines of the form ``Name: words`` as ``speaker`` and ``said``; bullets are not turns."""
    pattern = rf"(?s)^({_NAME}): (.+)$"
    return lines.withColumn("speaker", F.regexp_extract(text, pattern, 1)).filter("speaker <> ''").withColumn(
        "said", F.regexp_extract(text, pattern, 2)
    )


# How a task's priority and status may be written in brackets.
_PRIORITY = r"(?i)\s*\((?:priority:\s*)?(high|medium|low|urgent)\)"
_STATUS = r"(?i)\s*\[(open|done|pending|in progress|blocked|x)\]"


def action_items(bullets: DataFrame) -> DataFrame:
    """Task, owner, deadline, priority and status of the bullets under ACTION ITEMS.

    An absent owner or deadline is NULL, an absent priority or status is empty; ``[x]`` means done.
    """
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    items = bullets.filter("section = 'ACTION ITEMS'")
    marked = F.regexp_replace(F.regexp_replace("item", _PRIORITY, ""), _STATUS, "")
    task = F.trim(F.regexp_replace(marked, rf"^{_NAME}:\s*", ""))
    status = F.lower(F.regexp_extract("item", _STATUS, 1))
    return items.withColumns({
        "owner": blank_to_null(F.regexp_extract("item", rf"^({_NAME}):", 1)),
        "deadline": blank_to_null(F.regexp_extract("item", rf"\bby {_WHEN}\b", 1)),
        "task": task,
        "priority": F.lower(F.regexp_extract("item", _PRIORITY, 1)),
        "status": F.when(status == "x", "done").otherwise(status),
    })


# Words that point at a type of content, in order of preference.
CONTENT_WORDS: dict[str, tuple[str, ...]] = {
    "meeting_structured": ("agenda", "attendees", "decisions:", "action items:", "minutes"),
    "meeting_brainstorm": ("brainstorm", "idea", "what if", "how about", "concept"),
    "meeting_status": ("status", "blocker", "progress", "update", "on track"),
    "notes_sequential": ("journal", "diary", "log entry", "this morning", "afterwards"),
    "notes_fragmented": ("todo", "random", "sketch", "misc", "remember to"),
}


def content_type(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """Type whose words occur most; ``general`` when none occurs."""
    lowered = F.lower(text)
    scored = texts.select(key, *[
        sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0)).alias(kind) for kind, words in CONTENT_WORDS.items()
    ])
    best = F.greatest(*CONTENT_WORDS)
    winner = F.coalesce(*[F.when((F.col(k) == best) & (best > 0), k) for k in CONTENT_WORDS], F.lit("general"))
    return scored.select(key, winner.alias("content_type"), best.alias("hits"))


# Record lists of an extraction: list, main text, person, other fields.
RECORDS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    "topics": ("theme", None, ("summary",)),
    "decisions": ("what", "who_decided", ("context", "timestamp")),
    "action_items": ("task", "owner", ("deadline", "priority", "status")),
    "key_statements": ("quote", "speaker", ("significance", "sentiment")),
    "open_questions": ("question", "raised_by", ("context",)),
    "ideas": ("concept", "proposer", ("feasibility", "novelty")),
    "tensions": ("opposing_views", None, ("parties", "resolution_status")),
    "sentiment_arc": ("timestamp_or_section", None, ("sentiment", "trigger")),
}
_NULLABLE = ("deadline", "timestamp")


def _read(objects: Column, fields: str) -> Column:
    return F.transform(objects, lambda e: F.from_json(e, fields))


def extracted_items(responses: DataFrame, key: str, response: Column) -> DataFrame:
    """Records of a JSON answer in long form: ``key, kind, pos, text, person, fields``.

    Broken JSON is repaired first; list entries that are not objects are skipped; missing fields get
    their defaults. ``pos`` counts the kept records of a kind from 0.
    """
    # Every answer is parsed once, and every record once.
    lists = ", ".join(f"{kind} array<string>" for kind in RECORDS)
    # An answer beyond repair has no lists; a filter on the repair would make Spark repair twice.
    fixed = responses.select(key, json_repair(response).alias("fixed"))
    parsed = fixed.select(key, F.from_json("fixed.json", lists).alias("found"))
    parts = []
    for kind, (text, person, others) in RECORDS.items():
        objects = F.filter(F.col(f"found.{kind}"), lambda e: F.startswith(F.ltrim(e), F.lit("{")))
        names = [text, *([person] if person else []), *others]
        records = _read(objects, ", ".join(f"`{n}` string" for n in names))

        def record(e: Column, kind=kind, text=text, person=person, others=others) -> Column:
            field = lambda name: e[name]
            fields = [
                x for o in others
                for x in (F.lit(o), field(o) if o in _NULLABLE else F.coalesce(field(o), F.lit("")))
            ]
            return F.struct(
                F.lit(kind).alias("kind"), F.coalesce(field(text), F.lit("")).alias("text"),
                (field(person) if person else F.lit(None).cast("string")).alias("person"), F.create_map(*fields).alias("fields"),
            )

        parts.append(F.transform(records, lambda e, i: F.struct(i.alias("pos"), record(e).alias("r"))))
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast(_ITEMS)) for p in parts]))
    return parsed.select(key, F.explode(every).alias("x")).select(key, "x.r.kind", "x.pos", "x.r.text", "x.r.person", "x.r.fields")


_ITEMS = "array<struct<pos:int,r:struct<kind:string,text:string,person:string,fields:map<string,string>>>>"


def _blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) == ""


def narrative_metrics(items: DataFrame, key: str) -> DataFrame:
    """Counts per text in long form; only metrics above 0 appear."""
    of = lambda kind: F.col("kind") == kind
    counts = {
        "decisions_count": of("decisions"),
        "action_items": of("action_items"),
        "unowned_action_items": of("action_items") & _blank(F.col("person")),
        "action_items_without_deadline": of("action_items") & _blank(F.col("fields")["deadline"]),
        "topics_count": of("topics"),
        "open_questions": of("open_questions"),
        "ideas_count": of("ideas"),
        "tensions_count": of("tensions"),
    }
    wide = items.groupBy(key).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    return wide.unpivot([key], list(counts), "metric", "n").filter("n > 0")


# How many records of a kind become insights, and how many insights a text may have.
KIND_CAPS = {"open_questions": 5, "tensions": 3, "ideas": 3}
MAX_PRELIMINARY = 20
NOVEL = ("high", "novel", "innovative")
# How the headlines of the five rules begin.
HEADLINES = ("Unowned action: ", "No deadline: ", "Open question: ", "Tension: ", "High-novelty idea: ")


def first_n_per_kind(items: DataFrame, caps: dict[str, int] = KIND_CAPS) -> DataFrame:
    """The first records of the capped kinds; their position already counts within the kind."""
    keep = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("pos") < n) for k, n in caps.items()])
    return items.filter(keep)


def preliminary_insights(
    items: DataFrame, key: str, caps: dict[str, int] = KIND_CAPS, most: int = MAX_PRELIMINARY
) -> DataFrame:
    """Insights of each text in the order: unowned, undated, questions, tensions, ideas.

    ``found`` tells how many the text has in all, of which ``most`` are returned.
    """
    text, person, fields = F.col("text"), F.col("person"), F.col("fields")
    tasks = items.filter("kind = 'action_items'")
    capped = first_n_per_kind(items, caps)
    resolved = F.lower(fields["resolution_status"]) == "resolved"
    rules = [
        (tasks.filter(_blank(person)), HEADLINES[0], "absence", F.lit("warning"), "Nobody is responsible, so it may never be done."),
        (tasks.filter(_blank(fields["deadline"]) & ~_blank(person)), HEADLINES[1], "absence", F.lit("info"),
         "Without a date it competes with everything that has one."),
        (capped.filter("kind = 'open_questions'"), HEADLINES[2], "quote", F.lit("info"), "Work that depends on the answer has to wait."),
        (capped.filter("kind = 'tensions'"), HEADLINES[3], "pattern", F.when(resolved, "info").otherwise("warning"),
         "Someone should bring both sides together."),
        (capped.filter(F.col("kind") == "ideas").filter(F.lower(fields["novelty"]).isin(*NOVEL)), HEADLINES[4], "quote",
         F.lit("info"), "Name a person to look into it."),
    ]
    rows = reduce(DataFrame.unionByName, [
        df.select(
            key, F.lit(i).alias("rule"), "pos", F.concat(F.lit(title), F.substring(text, 1, 50), F.lit("...")).alias("headline"),
            F.lit(source).alias("source_type"), text.alias("reference"), person.alias("speaker"), severity.alias("severity"),
            F.lit(implication).alias("implication"),
        )
        for i, (df, title, source, severity, implication) in enumerate(rules)
    ])
    from pyspark.sql import Window

    # The cut is made in every partition before the shuffle.
    w = Window.partitionBy(key).orderBy("rule", "pos")
    first = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("rule", "pos")
    return first.join(rows.groupBy(key).agg(F.count("*").alias("found")), key)


# Records named in a summary.
SUMMARY_CAPS = {"decisions": ("Decisions", 5), "action_items": ("Action items", 5), "ideas": ("Ideas", 5), "tensions": ("Tensions", 3)}


def attribution_summary(
    items: DataFrame, key: str, caps: dict[str, tuple[str, int]] = SUMMARY_CAPS, chars: int = 80
) -> DataFrame:
    """One line per kind with its first records, cut to ``chars`` characters each; ``caps`` names and limits the kinds."""
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(name)) for k, (name, _) in caps.items()])
    few = first_n_per_kind(items, {k: n for k, (_, n) in caps.items()})
    grouped = few.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("pos", F.substring("text", 1, chars).alias("t")))).alias("s"))
    return grouped.select(
        key, "kind", F.concat(label, F.lit(": "), F.array_join(F.transform("s", lambda x: x["t"]), "; ")).alias("line")
    )


def speaker_segments(texts: DataFrame, key: str, text: str, segments: str) -> DataFrame:
    """Deal the non-blank lines of a transcript to its timed segments: ``key, place, line``.

    ``segments`` is an array of ``start, stop, speaker``. Each takes ``max(1, lines div segments)``
    lines; what is left over goes to the last speaker. The lines of a text never leave its row.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    base = texts.select(key, lines.alias("lines"), F.col(segments).alias("segs")).filter("size(lines) > 0 AND size(segs) > 0")
    share = F.greatest(F.lit(1), F.floor(F.size("lines") / F.size("segs")).cast("int"))
    stamp = lambda s: F.format_string("[%.1fs-%.1fs]", s["start"], s["stop"])
    dealt = F.transform(
        "segs",
        lambda s, i: F.struct(
            i.alias("place"), F.slice("lines", i * share + 1, share).alias("part"), F.concat_ws(" ", s["speaker"], stamp(s)).alias("who")
        ),
    )
    rest = F.slice("lines", F.size("segs") * share + 1, F.greatest(F.size("lines"), F.lit(1)))
    last = F.struct(F.size("segs").alias("place"), rest.alias("part"), F.element_at("segs", -1)["speaker"].alias("who"))
    spread = base.select(key, F.explode(F.concat(dealt, F.array(last))).alias("d")).select(key, "d.*")
    return spread.filter("size(part) > 0").select(key, "place", F.concat_ws(": ", "who", F.array_join("part", " ")).alias("line"))
