import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm.conversations import conversation_digests, damaged, repair_conversations
from gridloom.llm.four_russians import FORCED, moves, tables

GAPS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
OTHER = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """Least cost and then least initials by trying all edits; ``rows`` = (role, must go, truncated)."""

    after = None
    for i in range(len(rows), -1, -1):
        best = {}
        # Insertions come from a state whose own best is known: more of them first.
        for made in (3, 2, 1, 0):
            for state in ("", "s", "u", "a"):
                out = [(0, "")] if i == len(rows) and state in ("", "a") else []
                if made < 3:
                    cost, rest = best[OTHER[state][0], made + 1]
                    out.append((cost + 3, "I" + rest))
                if i < len(rows):
                    role, gone, cut = rows[i]
                    cost, rest = after[state, 0]
                    out.append((cost + 4, "D" + rest))
                    if not gone:
                        if to := NEXT.get((state, role[:1])):
                            cost, rest = after[to, 0]
                            out.append((cost + 3 * cut, "K" + rest))
                        cost, rest = after[OTHER[state][0], 0]
                        out.append((cost + 3 * cut + 3, "R" + rest))
                best[state, made] = min(out) if out else (10**9, "")
        after = best
    return after["", 0]


def brute(conv):
    """Digest of one conversation's rows (turn, role, text) by plain loops."""
    rows = []
    for turn, role, text in sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        rows.append((turn, role, text))
    seen, faults, symbols = set(), [0, 0, 0], []
    for _, role, text in rows:
        t = text.rstrip(GAPS)
        fault = 0 if not t else 1 if (role, text) in seen else 2 if t[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        symbols.append((role, fault in (0, 1), fault == 2))
    cost, audit = cheapest(tuple(symbols))
    state, out, at = "", [], 0
    for letter in audit:
        if letter == "I":
            role, text = OTHER[state], ""
        else:
            _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            role = OTHER[state] if letter == "R" else role
        state = role[0]
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def broken(rows):
    convs = defaultdict(list)
    for r in rows:
        key, turn, role, text = r["conv_id"], r["turn"], r["role"] if r["role"] is not None else " ", r["text"] if r["text"] is not None else " "
        found = convs[key]
        fate = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        found += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return convs


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(source, found):
    want = broken(source)
    found = [(r["conv_id"], tuple(r[c] for c in COLUMNS)) for r in found]
    assert len(found) == len(want)
    for key, got in found:
        assert got == brute(want[key])[0], key


def test_registered_query_matches_brute_force(spark, data):
    from gridloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    check(rows, QUERIES["op11_conversation_repair"](spark, data).collect())


def test_block_tables_against_all_edits():
    rng = random.Random(5)
    names = {0: "x", 1: "s", 2: "u", 3: "a", 4: "o"}
    for block in (1, 3, 4):
        t = tables(block)
        for _ in range(400):
            symbols = [rng.randrange(9) for _ in range(rng.randrange(12))]
            rows = tuple((names[s - 4 if s > 4 else s], s == 0, s > 4) for s in symbols)
            letters, cost, _ = t.trace(np.array(symbols, dtype=np.int64))
            assert (cost, letters) == cheapest(rows)
            _, at, low = t.edges(np.array(symbols, dtype=np.int64))
            assert t.vectors[at][0] + low == cost
    assert all(to in range(4) for s in range(4) for _, _, to in moves(s, 2)) and len(FORCED) == 4


def test_long_conversations_are_spread_over_chunks(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "usher", "", None, "tool"]
    texts = ["Done.", "What?", "cut off", " \n", "", None, "Ünï.", "same line!"]
    rows = [(7, i // 2 if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if i % 3 else f"row {i}.") for i in range(3000)]
    rows += [(8 + i % 40, i, rng.choice(roles), f"text {i}" + rng.choice(".!?,")) for i in range(400)]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_digests(damaged(source), chunk_rows=200).collect()
    check(source.collect(), found)
    # The repaired rows, chunk by chunk, are what the digest hashes.
    after = damaged(source).filter("present").drop("present")
    made = defaultdict(list)
    for r in sorted(repair_conversations(after, chunk_rows=200).collect(), key=lambda r: (r["chunk"], r["place"])):
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in found:
        assert hashlib.sha256("\n".join(made[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, "x"), (None, 1, "user", "Hi.", "x"), (None, 1, "user", "Hi.", "x"), (None, 2, "assistant", "Yes.", None),
        (1, -5, "system", "Be kind.", None), (1, 2**40, "user", "a" * 3_000_000 + ".", None), (1, 3, None, "word", None),
        (2, None, "", "", None), (3, 0, "assistant", "Only me.", "y"), (4, -(2**63), "user", "a.", None), (4, 2**63 - 1, "user", "b.", None),
    ] + [(100 + i, 0, "user", "One.", None) for i in range(40)]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Audit string")
    found = conversation_digests(damaged(source)).collect()
    want = broken(source.collect())
    assert {r["conv_id"] for r in found} == set(want) and len(found) == len(want)
    for r in found:
        wanted = brute(want[r["conv_id"]])[0]
        got = tuple(r[c] for c in COLUMNS)
        assert got[1:] == wanted[1:] and got[0] == (wanted[0] if wanted[0] < 2**63 else None)
    empty = [r for r in found if not want[r["conv_id"]]]
    assert empty and all(r["cost"] == 0 and r["audit"] == "" and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    none = source.filter("conv_id = -1")
    assert conversation_digests(damaged(none)).collect() == [] and repair_conversations(none).collect() == []
    with pytest.raises(ValueError):
        repair_conversations(source.drop("turn"))
