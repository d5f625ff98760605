"""Repair of conversations against all edits that cost no more, and what the search holds."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from affinis.llm import conversations, queries
from tests.llm.plain import CLASHES, sorted_rows

WHITE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in [*CLASHES, "fault", "edit", "step", "cost"])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """(cost, audit, texts) by trying all ways, a row at a time; inserts of up to two before each row and at the end."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    paths = {"": (0, "", ())}

    def better(table, state, path):
        if state not in table or path < table[state]:
            table[state] = path

    def inserted(paths):
        out = dict(paths)
        for state, (cost, audit, texts) in paths.items():
            for n in (1, 2):
                to, more = state, ()
                for _ in range(n):
                    to, name = ("a", "assistant") if to == "u" else ("u", "user")
                    more += (name + ":",)
                better(out, to, (cost + 5 * n, audit + "I" * n, texts + more))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        extra = 5 if fault == "truncated" else 0
        for state, (cost, audit, texts) in inserted(paths).items():
            better(new, state, (cost + 2, audit + "D", texts))
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in follows:
                    better(new, follows[state, role[:1]], (cost + extra, audit + "K", (*texts, f"{role}:{text}")))
                to, name = ("a", "assistant") if state == "u" else ("u", "user")
                better(new, to, (cost + 1 + extra, audit + "R", (*texts, f"{name}:{text}")))
        paths = new
    return min(p for state, p in inserted(paths).items() if state in ("", "a"))


def exhaustive_edits(rows, faults):
    """(cost, audit) over every string of edits, the pattern checked at the end."""
    best = None
    for edits in product("DKRI", repeat=len(rows) + 2):
        for size in range(len(rows), len(rows) + 3):
            audit = edits[:size]
            if len([e for e in audit if e != "I"]) != len(rows):
                continue
            choices = [[]]
            cost, row = 0, 0
            for e in audit:
                if e == "I":
                    cost, choices = cost + 5, [c + [x] for c in choices for x in "ua"]
                    continue
                (_, _, role, _), fault = rows[row], faults[row]
                row += 1
                if e != "D" and fault in ("blank", "duplicate"):
                    choices = []
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and fault == "truncated" else 0)
                if e != "D":
                    choices = [c + [x] for c in choices for x in ([role[:1] or "?"] if e == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in choices):
                found = (cost, "".join(audit))
                best = found if best is None else min(best, found)
    return best


def plain_report(rows):
    groups = defaultdict(list)
    for row in plain_damage(rows):
        groups[row[0]].append(row)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = plain_faults(own)
        cost, audit, texts = plain_edits(own, faults)
        turns = {r[1] for r in own} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        ))
    return out


def made_rows(seed, convs, longest):
    dice = random.Random(seed)
    rows = []
    for conv in range(convs):
        conv = None if conv == 0 else conv
        for turn in range(dice.randint(1, longest)):
            turn = dice.choice([turn, turn, turn, turn * 3, None])
            role = dice.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", "", None, "sage"])
            text = dice.choice(["Yes.", "No!", "Why?  \n", "and then", "", " \t", None, "...", "Ünïcödé ½?", f"t{dice.randint(0, 30)}.", "x\x1c", "a.\x1c"])
            rows.append((conv, turn, role, text))
    return rows + rows[::7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * (len(CLASHES) + 4)) for r in rows], SCHEMA)


def test_reports_equal_plain(spark):
    rows = made_rows(1, 60, 14)
    df = frame(spark, rows).repartition(5)
    got = conversations.reports(conversations.repair(conversations.damaged(df)), df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted_rows(got.collect()) == sorted_rows(plain_report(rows))


def test_plain_equals_all_edits():
    dice = random.Random(2)
    for _ in range(60):
        rows = [(1, i, dice.choice(["system", "user", "assistant", "tool"]), str(i)) for i in range(dice.randint(0, 4))]
        faults = [dice.choice([None, None, None, "truncated", "blank"]) for _ in rows]
        cost, audit, _ = plain_edits(rows, faults)
        assert (cost, audit) == exhaustive_edits(rows, faults)


def test_search_equals_plain_and_stays_small():
    dice = random.Random(3)
    for trial in range(300):
        n = dice.choice([1, 3, 8, 60])
        weights = [dice.random() for _ in range(5)]
        rows = [(1, i, dice.choices(["system", "user", "assistant", "tool", ""], weights)[0], str(i)) for i in range(n)]
        faults = [dice.choices([None, "truncated", "blank", "duplicate"], [5, dice.random() * 5, 1, 1])[0] for _ in rows]
        search, final = conversations.Search(), []
        for row, fault in zip(rows, faults):
            final += search.add(row, row[2][:1], fault)
        final += search.end()
        cost, audit, texts = plain_edits(rows, faults)
        assert "".join(e for e, *_ in final) == audit and (final[-1][3] if final else 0) == cost
        got = [f"{role or row[2]}:{row[3] if row else ''}" for e, role, row, _ in final if e != "D"]
        assert got == list(texts)


def held(search):
    nodes = set()
    for tip in search.tips.values():
        while tip is not None:
            nodes.add(id(tip))
            tip = tip.before
    return len(nodes)


@pytest.mark.parametrize("roles", ["ua", "uas", "uuast", "s", "t", "st"])
@pytest.mark.parametrize("fault", [None, "truncated", "blank"])
def test_unresolved_part_is_bounded(roles, fault):
    """However long the conversation, few nodes are held, and none that no survivor uses."""
    dice = random.Random(4)
    search, most, rows, out, made = conversations.Search(), 0, 6000, 0, []
    for i in range(rows):
        role = roles[i % 2] if roles == "ua" and dice.random() < 0.9 else dice.choice(roles)
        out += len(search.add((i,), role, fault if dice.random() < 0.3 else None))
        made.append(held(search))
    assert max(made) < 400 or roles in ("s", "t", "st")  # rows of one kind: the answer hangs on their number
    assert out > rows - 400 or roles in ("s", "t", "st")


def test_the_end_decides_the_beginning():
    """Rows of one role, by the ten thousand: an odd number costs a deletion, which ties put first."""
    for n in (9_999, 10_000):
        search, final = conversations.Search(), []
        for i in range(n):
            final += search.add((i,), "u", None)
        final += search.end()
        assert "".join(e for e, *_ in final) == ("DKR" if n % 2 else "KR") + "KR" * (n // 2 - 1)


def test_edits_of_the_operator(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "So?"), (2, 5, "user", "Only me"), (3, None, None, None)]
    got = {(r.conv_id, r.step): (r.edit, r.cost, r.turn, r.fault, r.role, r.repaired_role, r.text) for r in conversations.repair(frame(spark, rows)).collect()}
    assert got == {
        (1, 1): ("K", 0, 0, None, "system", "system", "Be kind."), (1, 2): ("R", 1, 1, None, "assistant", "user", "Hi."),
        (1, 3): ("K", 0, 2, None, "assistant", "assistant", "So?"), (2, 1): ("D", 2, 5, "truncated", "user", None, "Only me"),
        (3, 1): ("D", 2, None, "blank", " ", None, " "),
    }


def test_empty_and_all_dropped(spark):
    none = frame(spark, [])
    assert conversations.reports(conversations.repair(conversations.damaged(none)), none).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = frame(spark, [(conv, 0, "user", "Gone.")])
    got = conversations.reports(conversations.repair(conversations.damaged(one)), one).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "no end " * 100_000)]
    df = frame(spark, rows)
    assert sorted_rows(conversations.reports(conversations.repair(conversations.damaged(df)), df).collect()) == sorted_rows(plain_report(rows))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted_rows(queries.op11_conversations(spark, sf).collect()) == sorted_rows(plain_report(rows))
