"""Conversation structure repair: the cheapest edits that give every conversation a legal role sequence.

A row is kept (0), given the role user or assistant (3) or deleted (4); an empty turn of the user or the
assistant may be inserted anywhere (3). Blank and repeated rows must be deleted; a truncated row that stays
costs 3 more. Legal is a conversation without rows or an optional system turn followed by user-assistant pairs.
The cheapest edits are found by Four-Russians block tables (:mod:`gridloom.llm.four_russians`).

A conversation of any length is spread over chunks of bounded size: rows are sorted into range chunks once and
numbered; each chunk maps every cost vector behind it to the one in front, a scan over the chunks of a long
conversation (one small row a chunk) sets the vector behind each, another the state each is entered in, and
then every chunk is traced on its own. Only a digest of a whole conversation, one SHA-256, has to read its rows
in order; it does so in a stream that holds one batch.

Defined cases: NULL role or text is one space; a NULL turn comes first; a NULL ``conv_id`` is a conversation like
any other. Rows of one turn follow by role, then by the first 64 characters of the text, then by its MD5;
repeated rows are adjacent and all but the first are duplicates. Ties between edits go to the ASCII-least
string of initials (D, I, K, R). Texts of any length are read whole, once for the sort and once for the digest.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import GAP_CHARS, batches, tidy
from gridloom.llm.four_russians import _KEEPS, ASSISTANT, EMPTY, FORCED, USER, tables
from gridloom.session import cut_lineage, per_key

NEED = ("conv_id", "turn", "role", "text")
#: Rows that a chunk should hold; a task holds one symbol and one number for each.
CHUNK_ROWS = 250_000
BATCH = 1000
LEGAL = ("su", "ua", "au")
INITIALS = {"s": 1, "u": 2, "a": 3}
NAMES = {USER: "user", ASSISTANT: "assistant"}
_FAULTS = ("blank", "duplicate", "truncated")


def place_rows(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows in order, written once: ``_c`` (key of the conversation), ``_at`` (its place), ``_chunk``.

    A row whose column ``present`` is false only names its conversation.
    """
    spark = rows.sparkSession
    gone = F.lit(False) if "present" not in rows.columns else ~F.col("present")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    ends = F.rtrim(text, F.lit(GAP_CHARS))
    slim = rows.select(
        F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("_c"),
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (~gone).alias("present"),
        F.when(ends == "", 1).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), 3).otherwise(0).alias("_fault"),
        F.md5(text.cast("binary")).alias("_md5"), F.substring(text, 1, 64).alias("_head"),
        # Rows that are alike in all else may stand in any order, so a number keeps them apart.
        F.monotonically_increasing_id().alias("_salt"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // chunk_rows))
    order = ["_c", "turn", "role", "_head", "_md5", "_salt"]
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    same = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("_md5")).cast("binary")))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).select(
        "_c", "conv_id", "_at", F.shiftright("_at", 33).alias("_chunk"), "turn", "role", "text", "present", "_fault",
        F.when(F.col("present") & (F.col("_fault") != 1), same).alias("_same"),
    )
    return cut_lineage(placed, "conversation-rows")


def _symbols(placed: DataFrame) -> DataFrame:
    """One row per (conversation, chunk): symbols of its rows in order, and how many have each fault."""
    slim = placed.select("_c", "conv_id", "_chunk", "_at", "present", F.substring("role", 1, 1).alias("_r"), "_fault", "_same")
    twice = slim.filter("_same IS NOT NULL").groupBy("_c", "_same").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    seen = slim.join(per_key(twice.filter("_n > 1").drop("_n")), ["_c", "_same"], "left")
    fault = F.when(F.col("_first") < F.col("_at"), 2).otherwise(F.col("_fault"))
    role = F.when(F.col("_r") == "s", 1).when(F.col("_r") == "u", 2).when(F.col("_r") == "a", 3).otherwise(4)
    symbol = F.when(fault.isin(1, 2), 0).otherwise(role + F.when(fault == 3, 4).otherwise(0)).cast("tinyint")
    seen = seen.withColumns({"_fault": fault, "_symbol": symbol})
    listed = F.sort_array(F.collect_list(F.when(F.col("present"), F.struct("_at", "_symbol"))))
    return seen.groupBy("_c", "_chunk").agg(
        F.first("conv_id").alias("conv_id"), F.transform(listed, lambda x: x["_symbol"]).alias("symbols"),
        *[F.count_if(F.col("present") & (F.col("_fault") == k + 1)).alias(name) for k, name in enumerate(_FAULTS)],
    )


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, edges = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(edges[:-1], edges[1:]))


def _maps(arrow_batches):
    for batch in arrow_batches:
        through = [tables().through(s).tolist() for s in _lists(batch.column("symbols"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_c"), batch.column("_chunk"), pa.array(through, type=pa.list_(pa.int32()))], ["_c", "_chunk", "through"]
        )


def _rights(chunks: pd.DataFrame) -> pd.DataFrame:
    """The vector behind each chunk of one conversation, from the last to the first."""
    chunks = chunks.sort_values("_chunk", ascending=False)
    at, right = 0, []
    for through in chunks["through"]:
        right.append(at)
        at = int(through[at])
    out = chunks[["_c", "_chunk"]].assign(right=right, last=False)
    out.iloc[0, 3] = True
    return out


def _ends(arrow_batches):
    for batch in arrow_batches:
        right, last = batch.column("right").to_pylist(), batch.column("last").to_pylist()
        ends = [
            [tables().trace(s, r, state, z)[2] for state in range(len(FORCED))]
            for s, r, z in zip(_lists(batch.column("symbols")), right, last)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("_c", "_chunk", "right", "last")] + [pa.array(ends, type=pa.list_(pa.int32()))],
            ["_c", "_chunk", "right", "last", "ends"],
        )


def _starts(chunks: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("_chunk")
    state, start = EMPTY, []
    for ends in chunks["ends"]:
        start.append(state)
        state = int(ends[state])
    return chunks[["_c", "_chunk", "right", "last"]].assign(start=start)


def _traces(arrow_batches):
    for batch in arrow_batches:
        given = zip(
            _lists(batch.column("symbols")), *[batch.column(c).to_pylist() for c in ("right", "start", "last")]
        )
        found = [tables().trace(s, right, start, last) for s, right, start, last in given]
        kept = [c for c in batch.schema.names if c not in ("symbols", "right", "last")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())],
            kept + ["edits", "cost"],
        )


def find_edits(placed: DataFrame) -> DataFrame:
    """``_c, conv_id, _chunk, blank, duplicate, truncated, start, edits, cost`` per (conversation, chunk)."""
    chunks = cut_lineage(_symbols(placed), "conversation-symbols")
    # Every chunk cuts at most one conversation at each of its two ends, so these tables grow with the chunks.
    long = per_key(chunks.groupBy("_c").agg(F.count("*").alias("_n")).filter("_n > 1").select("_c"))
    maps = chunks.join(long, "_c", "left_semi").select("_c", "_chunk", "symbols").mapInArrow(_maps, "_c string, _chunk long, through array<int>")
    rights = maps.groupBy("_c").applyInPandas(_rights, "_c string, _chunk long, right int, last boolean")
    rights = per_key(rights)
    ends = chunks.select("_c", "_chunk", "symbols").join(rights, ["_c", "_chunk"]).mapInArrow(
        _ends, "_c string, _chunk long, right int, last boolean, ends array<int>"
    )
    starts = ends.groupBy("_c").applyInPandas(_starts, "_c string, _chunk long, right int, last boolean, start int")
    given = chunks.join(per_key(starts), ["_c", "_chunk"], "left").withColumns({
        "right": F.coalesce("right", F.lit(0)), "start": F.coalesce("start", F.lit(EMPTY)), "last": F.coalesce("last", F.lit(True)),
    })
    key = dict(chunks.dtypes)["conv_id"]
    schema = f"_c string, _chunk long, conv_id {key}, blank long, duplicate long, truncated long, start int, edits string, cost long"
    order = ["_c", "_chunk", "conv_id", *_FAULTS, "start", "symbols", "right", "last"]
    return cut_lineage(given.select(*order).mapInArrow(_traces, schema), "conversation-edits")


class _Replay:
    """Applies the edits of one chunk to its rows as they come by."""

    def __init__(self, edits: str, state: int):
        self.edits, self.at, self.state = edits, 0, state

    def _made(self) -> tuple[str, str, str]:
        self.state = FORCED[self.state]
        return "I", NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at] == "I":
            self.at += 1
            yield self._made()
        letter = self.edits[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEEPS[self.state, INITIALS[role[0]]]
            yield letter, role, text
        elif letter == "R":
            self.state = FORCED[self.state]
            yield letter, NAMES[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for _ in range(self.at, len(self.edits)):
            yield self._made()
        self.at = len(self.edits)


_LINE = ("_c", "_kind", "conv_id", "_chunk", "turn", "role", "text", "start", "edits", "cost", *_FAULTS)


def _lines(placed: DataFrame, edits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows in order, the edits of a chunk in front of them, all of one ``by`` in one sorted partition."""
    rows = placed.filter("present").select("_c", F.lit(1).alias("_kind"), "_chunk", "_at", "turn", "role", "text")
    heads = edits.withColumns({"_kind": F.lit(0), "_at": F.call_function("shiftleft", F.col("_chunk"), F.lit(33))})
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition(*by).sortWithinPartitions("_c", "_at", "_kind").select(*_LINE)


def _repaired(arrow_batches):
    replay = head = place = None

    def out(made):
        nonlocal place
        kept = []
        for letter, role, text in made:
            kept.append((head["conv_id"], head["_chunk"], place, letter, role, text))
            place += 1
        return kept

    schema = None
    for batch in arrow_batches:
        found = []
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), ("place", pa.int64()),
                            ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        for line in batch.to_pylist():
            if line["_kind"] == 0:
                if replay:
                    found += out(replay.rest())
                head, replay, place = line, _Replay(line["edits"], line["start"]), 0
            else:
                found += out(replay.row(line["role"], line["text"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema) if found else pa.RecordBatch.from_pylist([], schema)
    if replay and (found := out(replay.rest())):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def repair_conversations(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired rows: ``conv_id, chunk, place, edit, role, text``; ``chunk, place`` give their order."""
    placed = place_rows(tidy(rows, NEED), chunk_rows)
    lines = _lines(placed, find_edits(placed), ("_c", "_chunk"))
    key = dict(placed.dtypes)["conv_id"]
    with batches(rows.sparkSession, BATCH):
        done = lines.mapInArrow(_repaired, f"conv_id {key}, chunk long, place long, edit string, role string, text string")
        return cut_lineage(done, "conversations-repaired")


class _Digest:
    """What is told of one conversation, gathered while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.replay, self.counts = conv_id, None, [0] * 4
        self.hash, self.any, self.audit = hashlib.sha256(), False, []
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.before = None

    def head(self, line: dict) -> None:
        self.close()
        self.replay = _Replay(line["edits"], line["start"])
        self.audit.append(line["edits"])
        self.counts = [a + line[c] for a, c in zip(self.counts, (*_FAULTS, "cost"))]

    def close(self) -> None:
        if self.replay:
            self.add(self.replay.rest())

    def add(self, made) -> None:
        for _, role, text in made:
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self, line: dict) -> None:
        turn, initial = line["turn"], line["role"][:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.add(self.replay.row(line["role"], line["text"]))

    def result(self) -> tuple:
        self.close()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        blank, duplicate, truncated, cost = self.counts
        # A span of turns wider than 64 bits has no number.
        return (self.conv_id, gaps if gaps < 1 << 63 else None, blank, duplicate, truncated, self.illegal, cost,
                "".join(self.audit), self.hash.hexdigest())


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(arrow_batches):
    now = key = schema = None
    for batch in arrow_batches:
        long, text = pa.int64(), pa.string()
        kinds = [batch.schema.field("conv_id").type, *[long] * 6, text, text]
        schema = pa.schema(list(zip(["conv_id", *[c.split()[0] for c in _DIGEST.split(", ")]], kinds)))
        done = []
        for line in batch.to_pylist():
            if line["_c"] != key:
                if now:
                    done.append(now.result())
                now, key = _Digest(line["conv_id"]), line["_c"]
            (now.row if line["_kind"] else now.head)(line)
        yield _table(done, schema)
    if now:
        yield _table([now.result()], schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def conversation_digests(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: its faults, the cost and initials of its edits, SHA-256 of what is left.

    ``gaps`` = turn numbers missing between the first and the last, ``illegal`` = neighbours whose role initials
    may not follow one another, both before the repair. Conversations named only by rows whose ``present`` is
    false have no rows: zeros, no edits, the hash of nothing.
    """
    placed = place_rows(rows, chunk_rows)
    lines = _lines(placed, find_edits(placed), ("_c",))
    key = dict(placed.dtypes)["conv_id"]
    with batches(rows.sparkSession, BATCH):
        return cut_lineage(lines.mapInArrow(_digests, f"conv_id {key}, {_DIGEST}"), "conversation-digests")


def damaged(rows: DataFrame) -> DataFrame:
    """A fixed tenth or so of faults of every kind, by a checksum of ``conv_id:turn``; dropped rows are not ``present``."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return tidy(rows, NEED).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"), F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")
