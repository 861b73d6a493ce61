import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from sheaf.llm import queries, turnrepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")


def damaged_rows(rows):
    out = []
    for c, t, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        role, text = shown(role), shown(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(c, t, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def plain(rows, damage=True):
    """The rule of one conversation by plain search over turns and shapes."""
    seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    rows = damaged_rows(rows) if damage else rows
    md5 = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, md5(r)))
    for _, _, role, text in rows:
        body = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role, text, fault))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}  # last initial to the next ones

    @lru_cache(None)
    def best(i, last, inserts):
        options = []
        if i == len(turns) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for x in follow[last].replace("s", ""):
                cost, audit, lines = best(i, x, inserts + 1)
                options.append((cost + 3, "I" + audit, ("user:" if x == "u" else "assistant:",) + lines))
        if i < len(turns):
            role, text, fault = turns[i]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role[:1] and role[:1] in follow[last]:
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}",) + lines))
                for x in follow[last].replace("s", ""):
                    cost, audit, lines = best(i + 1, x, 0)
                    options.append((cost + extra + 3, "R" + audit, (f"{'user' if x == 'u' else 'assistant'}:{text}",) + lines))
        return min(options) if options else (1 << 30, "", ())

    for i in range(len(turns), -1, -1):  # keeps the recursion shallow
        for last in follow:
            best(i, last, 0)
    cost, audit, lines = best(0, "", 0)
    assert SHAPE.fullmatch("".join(x[:1] for x in lines))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def compare(got, rows, damage=True):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(found) and set(found) == set(by)
    for c in by:
        want = plain(by[c], damage)
        assert found[c] == want, (c, found[c], want)


def random_rows(rng, convs, longest):
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    out = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "No", None, " ", "Why?\n", f"turn {t}.", f"turn {t}", "é!", "a.b"])
            out.append((c, None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 5]), role, text))
    return out


@pytest.mark.parametrize("rows_a_block", [2048, 7])
def test_against_plain_search(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(turnrepair, "BLOCK_ROWS", rows_a_block)
    rng = random.Random(5)
    rows = random_rows(rng, [*range(60), None], 25)
    rows += [(70, t, "user", "same") for t in range(40)] + [(71, t, "user", f"u{t}") for t in range(45)] + [(72, 3, "user", "x.")] * 20
    rows += [(73, t, ("assistant", "user")[t % 2], f"x{t}.") for t in range(60)] + [(74, t, "system", f"x{t}.") for t in range(30)]
    rows += [(75, None, "user", None), (76, 1, "user", "long. " * 40000), (76, 2, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "'y' AS block", "1 AS n", "2 AS m").repartition(5)
    compare(turnrepair.repair(df, damaged=True).collect(), rows)
    compare(turnrepair.repair(df).collect(), rows, damage=False)
    assert turnrepair.repair(df.limit(0), damaged=True).count() == 0


def test_one_conversation_in_many_chunks(spark, monkeypatch):
    """Fix-up passes and, where they don't settle, whole matrices give what one run over all turns gives."""
    monkeypatch.setattr(turnrepair, "BLOCK_ROWS", 6)
    rng = random.Random(9)
    hot = []
    for t in range(400):
        kind = t // 100
        role = "user" if kind == 0 else ("user", "assistant")[t % 2] if kind == 1 else rng.choice(["user", "assistant", "system"]) if kind == 2 else "assistant"
        hot.append((5, t, role, "again." if kind == 1 and t % 3 else f"t{t}."))
    rows = hot + [(6, t, "user", f"v{t}") for t in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert turnrepair._blocks(df).select("block").distinct().count() >= 80
    for passes in (0, 1, 50):
        compare(turnrepair.repair(df, passes=passes).collect(), rows, damage=False)


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op12_repair(spark, sf).collect(), rows)
