import itertools
import random
from collections import defaultdict

from proofsieve.llm import chat

P = chat.Prices()


def brute_cost(roles):
    """Least cost over all ways to treat every turn, by trying them all."""
    best = chat.INF
    for treated in itertools.product([0, 1, 2, 3], repeat=len(roles)):  # 0: merge, else the state of its own turn
        state, cost = 0, 0
        for role, to in zip(roles, treated):
            if to == 0:
                if state == 0:
                    cost = chat.INF
                    break
                cost += P.merge + (chat.ROLES[state] != role) * P.relabel
                continue
            path = chat.inserted(state, to)
            if path is None:
                cost = chat.INF
                break
            cost += P.insert * len(path) + (chat.ROLES[to] != role) * P.relabel
            state = to
        best = min(best, cost + P.insert * len(chat.closing(state)))
    return best


def path_cost(roles, path):
    cost = sum(chat.steps(r, P)[a][b][0] for r, (a, b, _) in zip(roles, path))
    return cost + P.insert * len(chat.closing(path[-1][1]))


def test_repair_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(150):
        roles = rng.choices(["system", "user", "assistant", "tool", ""], k=rng.randint(1, 5))
        assert path_cost(roles, chat.repair(roles, P)) == brute_cost(roles)
        k = rng.randint(0, len(roles))
        a, b = chat.costs(roles[:k], P), chat.costs(roles[k:], P)
        whole = chat.costs(roles, P)
        assert all(whole[s][t] == min(chat.INF, *(a[s][m] + b[m][t] for m in range(4))) or whole[s][t] >= chat.INF for s in range(4) for t in range(4))


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|") if x and not x.startswith("end")]
    state = 0
    for r in roles:
        to = chat.ROLES.index(r)
        assert state in chat.LEGAL[to], roles
        state = to
    assert state == 3


def test_chats(spark):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "User ", "system", None, "tool"]), f"t{c}.{t} <|x"))
    rows += [(100, t, "user" if t % 3 else "assistant", f"h{t}") for t in range(600)] + [(101, 0, "user", "same")] * 400
    rows += [(None, 1, "user", "n"), (None, None, None, None), (102, 0, "user", ""), (102, 1, "assistant", "z" * 100000)]
    turns = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, part int, piece string")
    got = chat.format_chats(turns).collect()
    assert len(got) == len(rows)
    by, want = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for r in rows:
        want[r[0]].append(r)
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv, own in by.items():
        own.sort(key=lambda r: r.seq)
        assert [r.seq for r in own] == [*range(len(own))]
        ordered = [(chat.normal(r[2]), r[3] or "") for r in sorted(want[conv], key=key)]
        text = "".join(r.piece for r in own)
        legal(text)
        whole = "".join(p for _, _, p in chat.pieces(ordered, P))
        assert text == whole or len(own) > 100  # stretches may take another of several cheapest repairs
        path = [(chat.ROLES.index(r.role), r.action) for r in own]
        before, cost = 0, 0
        for (role, _), (state, _) in zip(ordered, path):
            cost += chat.steps(role, P)[before][state][0]
            before = state
        assert cost + P.insert * len(chat.closing(before)) == path_cost([r for r, _ in ordered], chat.repair([r for r, _ in ordered], P))
    assert "".join(r.piece for r in by[102]) == "<|user|>\n<|end|>\n<|assistant|>\n" + "z" * 100000 + "<|end|>\n"
    assert chat.format_chats(turns.limit(0)).count() == 0
