import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from wayline.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(signature):
    """(cost, audit, roles) by Dijkstra over (row, roles so far in short), edits spelled out; ties ASCII-least."""
    import heapq

    def after(state, r):  # the grammar, by the last role
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(signature) and state in ("", "a"):
            return cost, audit
        done.add((i, state))
        for r in "ua":
            if after(state, r):
                heapq.heappush(heap, (cost + 3, audit + "I", i, after(state, r)))
        if i < len(signature):
            sign = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if sign != "d":
                extra = 3 if sign.isupper() else 0
                if after(state, sign.lower()):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after(state, sign.lower())))
                for r in "ua":
                    if after(state, r):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, after(state, r)))


def test_solve_every_short_signature():
    for n in range(5):
        for s in map("".join, product("dsuaxSUX", repeat=n)):
            assert repair.solve(s, None)[0][:2] == cheapest(s), s


def test_segments_are_solved_as_one():
    r = random.Random(3)
    for _ in range(300):
        whole = "".join(r.choice("dsuauauaxSUAX") for _ in range(r.randint(2, 30)))
        cuts = sorted(r.sample(range(1, len(whole)), r.randint(1, min(5, len(whole) - 1))))
        parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
        togo, after = [0, 6, 3, 0], []
        for p in parts[::-1]:
            after.append(togo)
            w = repair.ways(p)
            togo = [min(w[4 * s + t] + togo[t] for t in range(4)) for s in range(4)]
        state, cost, audit = 0, 0, ""
        for k, p in enumerate(parts):
            c, a, state = repair.solve(p, None if k == len(parts) - 1 else after[-1 - k])[state]
            cost, audit = cost + c, audit + a
        assert (cost, audit) == cheapest(whole)


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        f = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{f(c)}:{f(t)}".encode()) % 20
        role, text = f(role), f(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signature, counts = set(), "", dict.fromkeys(repair.FAULTS, 0)
        for _, role, text in own:
            last = text.strip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        cost, audit = cheapest(signature)
        left, rest = [], list(own)
        for e in audit:
            need = "assistant" if left and left[-1][0][:1] == "u" else "user"
            if e == "I":
                left.append((need, ""))
            else:
                _, role, text = rest.pop(0)
                if e != "D":
                    left.append((role if e == "K" else need, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left)) and not rest
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, digest), left
    return out


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(r.randint(0, 12)):
            role = r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = r.choice(["a.", "b!", "cut", " \n", "", None, "é?", "a. ", "x" * 70 + r.choice("ab.")])
            rows.append((c, None if r.random() < 0.1 else t - r.choice([0, 0, 1]), role, text))
    return rows


@pytest.mark.parametrize("bits", [9, 2])
def test_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = conversations(bits, 60)
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", audit int").repartition(3)
    left = brute_damage(rows)
    want = brute(left)
    got = repair.audits(repair.damaged(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()} and len(got) == len(want)
    lines = {}
    for r in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BITS", 5)
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["one.", "two.", f"own {t}.", "cut", "z" * 5_000 + "."])) for t in range(3_000)] + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
    got = {x.conv_id: tuple(x)[1:] for x in repair.audits(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {c: w[0] for c, w in brute([(c, t, a, b) for c, t, a, b in rows]).items()}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audits(empty).count() == repair.repaired(empty).count() == 0
    # the id column may have a name that the result has, too
    df = spark.createDataFrame([("k", None, None, None), ("k", None, "user", "a.")], "audit string, turn long, role string, text string")
    (r,) = repair.audits(df, "audit").collect()
    assert (r.audit, r.gaps, r.blank, r.cost) == ("k", 0, 1, 4 + 3)


def test_query(spark, tmp_path):
    rows = conversations(4, 80)
    # a conversation that loses its only row
    gone = next(c for c in range(1_000, 2_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "a."))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/conversations.parquet")
    want = {c: w[0] for c, w in brute(brute_damage(rows)).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = queries.op13_conversation_repair(spark, f"file://{tmp_path}").collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: want.get(c, none) for c in {r[0] for r in rows}} and len(got) == len({r[0] for r in rows})
    assert gone not in want
