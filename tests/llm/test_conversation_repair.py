import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from relaymill.llm import conversation_repair as C
from relaymill.llm import derivation as D

SF = "/root/testdata/sf0.01"
LAYOUT = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def cheapest(rows, most_inserts):
    """Every way to edit rows (initial, fault), tried out: the least (cost, audit)."""
    best = None
    edits = []
    for initial, fault in rows:
        extra = int(fault == D.TRUNCATED)
        options = [("D", "", 3)]
        if fault not in (D.BLANK, D.DUPLICATE):
            options += [("K", initial or "-", extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        edits.append(options)
    slots = len(rows) + 1
    inserts = [""] + ["".join(p) for n in range(1, most_inserts + 1) for p in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*edits):
        for put in itertools.product(inserts, repeat=slots):
            if sum(map(len, put)) > most_inserts:
                continue
            roles = put[0] + "".join(c[1] + p for c, p in zip(chosen, put[1:]))
            if not re.fullmatch("(s?(ua)+)?", roles):
                continue
            cost = sum(c[2] for c in chosen) + 2 * sum(map(len, put))
            audit = "I" * len(put[0]) + "".join(c[0] + "I" * len(p) for c, p in zip(chosen, put[1:]))
            best = min(best or (cost, audit), (cost, audit))
    return best


def by_blocks(rows, size):
    prefixes = {D.START: (0, "")}
    for at in range(0, len(rows), size):
        block = D.spans(rows[at : at + size], D.STATES if at else (D.START,))
        prefixes = D.joined(prefixes, block)
    return D.goal(prefixes)


def test_agenda_equals_trying_all_edits():
    rng = random.Random(3)
    kinds = [*itertools.product("sua", (D.SOUND, D.TRUNCATED)), ("u", D.BLANK), ("a", D.DUPLICATE), ("t", D.SOUND), ("", D.TRUNCATED)]
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)]
    cases += [[rng.choice(kinds) for _ in range(3)] for _ in range(25)]
    for rows in cases:
        wanted = cheapest(rows, 3 if len(rows) < 3 else 2)
        for size in (1, 2, 256):
            assert by_blocks(rows, size) == wanted, (rows, size)


def plain(rows, layout_order=("turn", "role", "text")):
    """The contract on rows in memory, one conversation after the other."""
    said = [(r.conv_id, r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text) for r in rows]
    out = []
    for conv in {s[0] for s in said}:
        kept = []
        for _, turn, role, text in (s for s in said if s[0] == conv):
            names = [" " if v is None else str(v) for v in (conv, turn)]
            harm = zlib.crc32(":".join(names).encode()) % 20
            if harm == 1:
                text = ""
            elif harm == 2:
                text = re.sub("[.!?]", "", text)
            elif harm == 4:
                role = "user"
            kept += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(harm, 1)
        kept.sort()
        faults, seen = [], set()
        for _, _, role, _, text in kept:
            if blank(text):
                faults.append(D.BLANK)
            elif (role, text) in seen:
                faults.append(D.DUPLICATE)
            else:
                faults.append(D.SOUND if text.rstrip(C.BLANKS)[-1] in ".!?" else D.TRUNCATED)
            seen.add((role, text))
        turns = {k[1] for k in kept if k[0]}
        initials = [k[2][:1] for k in kept]
        cost, audit = by_blocks(list(zip(initials, faults)), 10**6)
        lines, state, left = [], "", list(kept)
        for edit in audit:  # roles are told by what stood before
            due = "assistant" if state == "u" else "user"
            if edit == "I":
                role, text = due, ""
            else:
                *_, role, _, text = left.pop(0)
                role = due if edit == "R" else role
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[:1]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in (D.BLANK, D.DUPLICATE, D.TRUNCATED)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def digests(conversations):
    rows = C.Repairs(conversations, C.damaged(conversations)).digests().collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def test_query_equals_conversations_in_memory(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = sorted((tuple(r[c] for c in COLUMNS) for r in C.op13_conversation_repair(spark, SF).collect()), key=repr)
    assert got == plain(rows)
    for r in got:
        assert re.fullmatch("[DIKR]*", r[7])


@pytest.mark.parametrize("block", [3, 256])
def test_long_conversations_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    texts = ["One.", "two", "Three!", " ", "Four? ", "same.", "é."]
    rows = [(7, i // 2 if i % 50 else None, rng.choice(["user", "assistant", "system", "tool"]), f"{rng.choice(texts)}") for i in range(500)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"{c} {i}.") for c in range(20) for i in range(c % 4)]
    table = spark.createDataFrame(rows, LAYOUT)
    assert digests(table) == plain(table.collect())


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hello."), (1, None, "user", "a" * 300_000), (1, None, None, "."),
        (2, 5, "assistant", "Yes."), (2, 5, "assistant", "Yes."), (2, 5, "user", "Yes."), (2, 9, "", "\x85 x\x0b\n"),
        (3, -4, "system", "S."), (3, 2, "system", "S."), (4, 0, "user", None), (5, 1, "user", "\n\t"),
    ] + [(100 + i, 0, "user", "Only.") for i in range(60)]
    table = spark.createDataFrame(rows, LAYOUT)
    clash = table.withColumns({c: F.lit("x") for c in ("block", "pos", "part", "row", "digest", "harm", "copy", "kind", "audit")})
    got = digests(clash)
    assert got == plain(table.collect())
    gone = [g for g in got if g[0] and g[0] >= 100 and not g[7]]
    assert gone and all(g[1:7] == (0,) * 6 and g[8] == hashlib.sha256(b"").hexdigest() for g in gone)
    assert digests(spark.createDataFrame([], LAYOUT)) == []


def test_repaired_rows_have_the_grammar(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    repairs = C.Repairs(table, C.damaged(table))
    roles = {}
    rows = repairs.repaired().collect()
    for r in sorted(rows, key=lambda r: (r.conv_id, r.place)):
        roles.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in found)) for found in roles.values())
    texts = {(r.conv_id, t.text): r.repaired_sha256 for r in repairs.digests().collect() for t in roles.get(r.conv_id, [])}
    for (conv, _), digest in texts.items():
        whole = "\n".join(f"{r.role}:{r.text}" for r in roles[conv])
        assert hashlib.sha256(whole.encode()).hexdigest() == digest
