"""Narrative operators over notes made from the conversations and the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import narrative as R
from gridloom.plans.registry import query


def _notes(load) -> DataFrame:
    """Every conversation as notes: title, spoken turns, then one section per role.

    A turn's lines become one line, since a bullet and a spoken turn are one line each.
    """
    talk = load("conversations").select("conv_id", "turn", "role", F.replace("text", F.lit("\n"), F.lit(" / ")).alias("t"))
    line = lambda df, at, text: df.select("conv_id", at.cast("bigint").alias("line_no"), text.alias("text"))
    turn, task = F.col("turn"), F.col("t")
    bullet = (
        F.when(turn % 3 == 0, F.concat(F.lit("- Alice: "), task, F.lit(" by Friday (high) [done]")))
        .when(turn % 3 == 1, F.concat(F.lit("- Bob: "), task, F.lit(" (priority: low)"))).otherwise(F.concat(F.lit("- "), F.lower(task)))
    )
    each = talk.select("conv_id").distinct()
    return reduce(DataFrame.unionByName, [
        line(each, F.lit(0), F.lit("Weekly meeting")),
        line(talk, turn + 1, F.concat(F.initcap("role"), F.lit(": "), task)),
        line(each, F.lit(10_000_000), F.lit("DECISIONS:")),
        line(talk.filter("role = 'assistant'"), turn + 10_000_001, F.concat(F.lit("- "), task)),
        line(each, F.lit(20_000_000), F.lit("Action items: ")),
        line(talk.filter("role = 'user'"), turn + 20_000_001, bullet),
        line(each, F.lit(30_000_000), F.lit("OPEN QUESTIONS:")),
        line(talk.filter("role = 'system'"), turn + 30_000_001, F.concat(F.lit("* "), task, F.lit("?"))),
    ])


_TALK_SQL = """talk AS (SELECT conv_id, turn, role, replace(text, chr(10), ' / ') AS t FROM conversations),
  bullets AS (SELECT conv_id, turn + 10000001 AS line_no, 'DECISIONS' AS section, t AS item, turn FROM talk WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn + 20000001, 'ACTION ITEMS', CASE turn % 3 WHEN 0 THEN 'Alice: ' || t || ' by Friday (high) [done]' WHEN 1 THEN 'Bob: ' || t || ' (priority: low)' ELSE lower(t) END, turn FROM talk WHERE role = 'user'
    UNION ALL SELECT conv_id, turn + 30000001, 'OPEN QUESTIONS', t || '?', turn FROM talk WHERE role = 'system')"""


@query("section_lines", f"WITH {_TALK_SQL} SELECT conv_id, line_no, section, item FROM bullets")
def _(load):
    return R.section_lines(_notes(load), "conv_id")


@query("speaker_turns", "SELECT conv_id, turn + 1 AS line_no, upper(role[1]) || role[2:] AS speaker, replace(text, chr(10), ' / ') AS said FROM conversations")
def _(load):
    return R.speaker_turns(_notes(load)).select("conv_id", "line_no", "speaker", "said")


@query(
    "action_items",
    f"""WITH {_TALK_SQL} SELECT b.conv_id, line_no, CASE turn % 3 WHEN 0 THEN 'Alice' WHEN 1 THEN 'Bob' END AS owner, CASE turn % 3 WHEN 0 THEN 'Friday' END AS deadline,
        CASE turn % 3 WHEN 0 THEN replace(replace(item, 'Alice: ', ''), ' (high) [done]', '') WHEN 1 THEN replace(replace(item, 'Bob: ', ''), ' (priority: low)', '') ELSE item END AS task,
        CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS priority, CASE turn % 3 WHEN 0 THEN 'done' ELSE '' END AS status FROM bullets b WHERE section = 'ACTION ITEMS'""",
)
def _(load):
    found = R.action_items(R.section_lines(_notes(load), "conv_id"))
    return found.select("conv_id", "line_no", "owner", "deadline", "task", "priority", "status")


_OPENINGS = ("Agenda and attendees. Decisions: none", "Brainstorm: what if", "Status update: progress, no blocker", "Journal of this morning", "Random todo, sketch", "Nothing here")
_OPENING_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OPENINGS)) + " END"
_HITS = ", ".join("(" + " + ".join(f"contains(x, '{w}')::INT" for w in ws) + f") AS {k}" for k, ws in R.CONTENT_WORDS.items())
_K = list(R.CONTENT_WORDS)


@query(
    "content_type",
    f"""WITH t AS (SELECT doc_id, lower({_OPENING_SQL} || chr(10) || text) AS x FROM documents), h AS (SELECT doc_id, {_HITS} FROM t),
        b AS (SELECT *, greatest({', '.join(_K)}) AS hits FROM h)
        SELECT doc_id, CASE WHEN hits = 0 THEN 'general' {' '.join(f"WHEN {k} = hits THEN '{k}'" for k in _K)} END AS content_type, hits FROM b""",
)
def _(load):
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return R.content_type(load("documents"), "doc_id", F.concat_ws("\n", opening, "text"))


def _responses(load) -> DataFrame:
    """An extraction answer per document: its lines dealt to five kinds, with junk and a fence."""
    lines = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct(i.alias("i"), t.alias("t"))
    )
    j = lambda *cols: F.to_json(F.struct(*cols))

    def pick(k: int, make):
        return F.array_join(F.transform(F.filter("lines", lambda x: x["i"] % 5 == k), make), ",")

    decisions = pick(0, lambda x: j(x["t"].alias("what")))
    actions = pick(1, lambda x: j(
        x["t"].alias("task"), F.when(x["i"] % 2 == 0, "Ann").alias("owner"), F.when(x["i"] % 3 == 0, "Monday").alias("deadline")))
    questions = pick(2, lambda x: j(x["t"].alias("question"), F.lit("Bo").alias("raised_by")))
    ideas = pick(3, lambda x: j(x["t"].alias("concept"), F.when(x["i"] % 2 == 0, "High").otherwise("low").alias("novelty")))
    tensions = pick(4, lambda x: j(x["t"].alias("opposing_views"), F.when(x["i"] % 2 == 0, "Resolved").otherwise("open").alias("resolution_status")))
    body = F.concat(
        F.lit('```json\n{"decisions":["oops",'), decisions, F.lit('],"action_items":['), actions, F.lit('],"open_questions":['), questions,
        F.lit('],"ideas":['), ideas, F.lit('],"tensions":['), tensions, F.lit(",],}\n```"),
    )
    return load("documents").withColumn("lines", lines).select("doc_id", body.alias("response"))


_ITEMS_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  items AS (SELECT doc_id, ['decisions', 'action_items', 'open_questions', 'ideas', 'tensions'][i % 5 + 1] AS kind, i // 5 AS pos, t AS text,
    CASE WHEN i % 5 = 1 AND i % 2 = 0 THEN 'Ann' WHEN i % 5 = 2 THEN 'Bo' END AS person, CASE WHEN i % 5 = 1 AND i % 3 = 0 THEN 'Monday' END AS deadline, i FROM l)"""


def _items(load):
    return load.shared("extracted_items", lambda: R.extracted_items(_responses(load), "doc_id", F.col("response")))


@query("extracted_items", f"WITH {_ITEMS_SQL} SELECT doc_id, kind, pos, text, person, deadline FROM items")
def _(load):
    return _items(load).select("doc_id", "kind", "pos", "text", "person", F.col("fields")["deadline"].alias("deadline"))


@query(
    "narrative_metrics",
    f"""WITH {_ITEMS_SQL}, m AS (SELECT doc_id, CASE kind WHEN 'decisions' THEN 'decisions_count' WHEN 'ideas' THEN 'ideas_count' WHEN 'tensions' THEN 'tensions_count' ELSE kind END AS metric FROM items
          UNION ALL SELECT doc_id, 'unowned_action_items' FROM items WHERE kind = 'action_items' AND person IS NULL
          UNION ALL SELECT doc_id, 'action_items_without_deadline' FROM items WHERE kind = 'action_items' AND deadline IS NULL)
        SELECT doc_id, metric, count(*) AS n FROM m GROUP BY 1, 2""",
)
def _(load):
    return R.narrative_metrics(_items(load), "doc_id")


_PRELIM_SQL = f"""{_ITEMS_SQL}, r AS (
    SELECT doc_id, 0 AS rule, pos, 'Unowned action: ' || substr(text, 1, 50) || '...' AS headline, 'warning' AS severity FROM items WHERE kind = 'action_items' AND person IS NULL
    UNION ALL SELECT doc_id, 1, pos, 'No deadline: ' || substr(text, 1, 50) || '...', 'info' FROM items WHERE kind = 'action_items' AND person IS NOT NULL AND deadline IS NULL
    UNION ALL SELECT doc_id, 2, pos, 'Open question: ' || substr(text, 1, 50) || '...', 'info' FROM items WHERE kind = 'open_questions' AND pos < 5
    UNION ALL SELECT doc_id, 3, pos, 'Tension: ' || substr(text, 1, 50) || '...', CASE WHEN i % 2 = 0 THEN 'info' ELSE 'warning' END FROM items WHERE kind = 'tensions' AND pos < 3
    UNION ALL SELECT doc_id, 4, pos, 'High-novelty idea: ' || substr(text, 1, 50) || '...', 'info' FROM items WHERE kind = 'ideas' AND pos < 3 AND i % 2 = 0)"""


@query("preliminary_insights", f"WITH {_PRELIM_SQL} SELECT * FROM (SELECT doc_id, headline, severity, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) AS place, count(*) OVER (PARTITION BY doc_id) AS found FROM r) WHERE place <= 20")
def _(load):
    return R.preliminary_insights(_items(load), "doc_id").select("doc_id", "headline", "severity", "place", "found")


@query("first_n_per_kind", f"WITH {_ITEMS_SQL} SELECT doc_id, kind, pos, text FROM items WHERE (kind = 'open_questions' AND pos < 5) OR (kind IN ('tensions', 'ideas') AND pos < 3)")
def _(load):
    return R.first_n_per_kind(_items(load)).select("doc_id", "kind", "pos", "text")


@query(
    "attribution_summary",
    f"""WITH {_ITEMS_SQL}, n AS (SELECT * FROM (VALUES ('decisions', 'Decisions', 5), ('action_items', 'Action items', 5), ('ideas', 'Ideas', 5), ('tensions', 'Tensions', 3)) t(kind, label, cap))
        SELECT doc_id, kind, any_value(label) || ': ' || string_agg(substr(text, 1, 80), '; ' ORDER BY pos) AS line FROM items JOIN n USING (kind) WHERE pos < cap GROUP BY 1, 2""",
)
def _(load):
    return R.attribution_summary(_items(load), "doc_id")


@query(
    "speaker_segments",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, doc_id % 4 + 1 AS n FROM documents),
       k AS (SELECT *, greatest(1, len(ls) // n) AS share FROM l WHERE len(ls) > 0),
       d AS (SELECT doc_id, place, ls[place * share + 1 : (place + 1) * share] AS part, 'SPEAKER_' || place || ' [' || place * 10 || '.0s-' || (place * 10 + 9) || '.5s]' AS who FROM k, generate_series(0, 3) g(place) WHERE place < n
             UNION ALL SELECT doc_id, n, ls[n * share + 1 :], 'SPEAKER_' || (n - 1) FROM k)
       SELECT doc_id, place, who || ': ' || array_to_string(part, ' ') AS line FROM d WHERE len(part) > 0""",
)
def _(load):
    segment = lambda i: F.struct(
        (i * 10).cast("double").alias("start"), (i * 10 + 9.5).cast("double").alias("stop"), F.concat(F.lit("SPEAKER_"), i.cast("string")).alias("speaker")
    )
    timed = load("documents").withColumn("segments", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 4), segment))
    return R.speaker_segments(timed, "doc_id", "text", "segments")
