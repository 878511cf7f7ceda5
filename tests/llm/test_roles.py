import itertools
import random

from embedmesh.llm.roles import Costs, Repair, Template, format_chats, known_role, summary, written


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and (not roles or bool(rest)) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def brute(seen, c=Costs()):
    """Least cost over all ways to write each turn (as a role, or merged), and all insertions that make the result legal."""
    best = 1 << 60
    for ways in itertools.product((0, 1, 2, -1), repeat=len(seen)):
        written, cost, ok = [], 0, True
        for way, own in zip(ways, seen):
            if way >= 0:
                cost += 0 if way == own else c.relabel_unknown if own < 0 else c.relabel
                written.append(way)
            elif not written:
                ok = False
            else:
                cost += c.merge if own < 0 or written[-1] == own else c.merge_other
        if not ok:
            continue
        # empty turns between: a system turn is legal at the start only
        state, more = None, 0
        for r in written:
            if r == 0:
                ok = state is None
            elif r == 1:
                more += state == 1
            else:
                more += state in (None, 0, 2)
            state = r
            if not ok:
                break
        if ok:
            more += {None: 0, 0: 2, 1: 1, 2: 0}[state]
            best = min(best, cost + c.insert * more)
    return best


def rendered(pieces):
    """(roles, texts) of joined pieces."""
    parts = [x.partition("|>\n") for x in "".join(pieces).split("<|end|>\n")[:-1]]
    assert all(a.startswith("<|") for a, _, _ in parts)
    return [a[2:] for a, _, _ in parts], [t for _, _, t in parts]


def test_least_cost():
    rng = random.Random(1)
    for _ in range(250):
        seen = [rng.choice((0, 1, 2, -1)) for _ in range(rng.randrange(1, 6))]
        names = {0: "system", 1: "User", 2: "gpt", -1: "tool?"}
        rows = list(written(Repair(), Template(), "\n\n", [(i, names[s], f"t{i}") for i, s in enumerate(seen)]))
        roles, texts = rendered(r[-1] for r in rows)
        assert legal(roles), seen
        # merges after an inserted turn never pay, so the brute version leaves them out
        assert sum(r[5] for r in rows) == Repair().plan(seen)[0] == brute(seen), seen
        assert [x for t in texts for x in t.split("\n\n") if x] == [f"t{i}" for i in range(len(seen))]
        assert sum(r[4] for r in rows) + sum(r[3] != "merged" for r in rows) == len(roles)


def test_rendering():
    assert [known_role(x) for x in (" User", "GPT", None, "x", "system")] == [1, 2, -1, -1, 0]
    turns = [(3, "user", "a<|end|>"), (4, "user", ""), (5, "user", "b"), (6, "bot", None)]
    rows = list(written(Repair(), Template(), "+", turns))
    assert [r[1:6] for r in rows] == [(3, "user", "kept", 0, 0), (4, None, "merged", 0, 1), (5, None, "merged", 0, 1), (6, "assistant", "kept", 0, 0)]
    assert "".join(r[6] for r in rows) == "<|user|>\na<\u200d|end|>+b<|end|>\n<|assistant|>\n<|end|>\n"


SCHEMA = "conv_id long, turn long, role string, text string"


def by_conversation(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r.place):
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_frames(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 2, "user", "c"), (3, 0, None, None), (None, 0, "user", "n"), (4, 0, "user", "r"),
        (4, 0, "user", "r"), (4, None, "system", "s"), (4, 1, "assistant", "z"), (5, 0, "system", "only"),
    ]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", "long " * 50) for i in range(2000)]
    made = format_chats(spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, cost string"))
    got, sums = by_conversation(made.collect()), {r.conv_id: r for r in summary(made).collect()}
    roles = {k: "".join(x[0] for x in rendered(r.piece for r in own)[0]) for k, own in got.items()}
    assert {k: (r.n_turns, roles[k], r.cost) for k, r in sums.items() if k not in (5, 6)} == {
        1: (2, "ua", 0), 2: (3, "uaua", 5), 3: (1, "ua", 6), None: (1, "ua", 5), 4: (3 + 1, "sua", 1)
    }
    assert legal(rendered(r.piece for r in got[5])[0]) and sums[5].cost == brute([0])
    assert sums[6].written == 2000 and sums[6].cost == 0 and "".join(r.piece for r in got[4]).startswith("<|system|>\ns<|end|>\n<|user|>\nr\n\nr<|end|>")
    assert all([r.place for r in own] == list(range(len(own))) for own in got.values())
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_where_a_conversation_is_cut_never_shows(spark):
    rng = random.Random(3)
    kinds = ["user", "assistant", "system", "odd", None]
    rows = [(c, rng.choice([t, t, 0, None]), rng.choice(kinds), rng.choice(["", None, f"t{t}", f"u{t}"])) for c in (1, 2, 5, 8, None) for t in range(rng.randrange(40, 90))]
    rows += [(7, 0, "user", "a"), (7, 1, "assistant", "b"), (9, None, None, None)] + [(3, None, "user", "same")] * 40 + [(4, 10**9 * t, kinds[t % 4], "x") for t in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(repr, format_chats(df).collect()))
    assert len(whole) == len(rows)
    for segment in (1, 7, 33):
        assert sorted(map(repr, format_chats(df, segment=segment).collect())) == whole
    assert sorted(map(repr, format_chats(df, segment=7, broadcast_ids=0).collect())) == whole


def test_ties_of_segments():
    """Turn for turn, for random conversations cut anywhere."""
    rng, repair = random.Random(8), Repair()
    for _ in range(3000):
        seen = [rng.choice((0, 1, 2, 3)) for _ in range(14)]
        total, path, tail = repair.plan(seen)
        cut = rng.randrange(1, 14)
        cost, back = repair.ahead(seen[:cut], [0] + [1 << 60] * 3)
        after, later = repair.ahead(seen[cut:], cost)
        state = repair.before(seen[cut:], later, repair.end(after)[1])
        assert repair.plan(seen[:cut], leave=state)[1] + repair.plan(seen[cut:], cost)[1] == path and repair.end(after)[0] == total
