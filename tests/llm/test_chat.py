import random

from kmerspark.llm import chat
from kmerspark.llm.chat import ASSISTANT, END_COST, NEXT, START, SYSTEM, UNKNOWN, USER, format_chats, repair


def brute(codes):
    best = [10**9]

    def go(i, s, c, run):
        if c >= best[0]:
            return
        if i == len(codes):
            best[0] = min(best[0], c + int(END_COST[s]))
            return
        r, blank = codes[i]
        for t in NEXT[s]:
            go(i + 1, t, c + (0 if t == r else chat.RELABEL_UNKNOWN if r == UNKNOWN else chat.RELABEL), 0)
            if run < 4:
                go(i, t, c + chat.INSERT, run + 1)
        if s != START and not run:
            go(i + 1, s, c + (chat.MERGE_BLANK if blank else chat.MERGE_SAME if s == r else chat.MERGE_UNKNOWN if r == UNKNOWN else chat.MERGE_OTHER), 0)

    go(0, START, 0, 0)
    return best[0]


def test_costs_equal_brute_force():
    r = random.Random(1)
    for _ in range(600):
        codes = [(r.randrange(4), r.random() < 0.2) for _ in range(r.randrange(7))]
        cost, path = repair(codes)
        assert cost == brute(codes)
        state = START
        for t, empties, kind in path:  # the path is legal
            for e in empties:
                assert e in NEXT[state]
                state = e
            assert t == state if kind == "merge" else t in NEXT[state]
            state = t


def rows_of(spark, convs):
    return spark.createDataFrame([(c, i if not isinstance(t[0], int) else t[0], t[-2], t[-1], "x") for c, turns in convs for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string, cost string")


def test_repairs(spark):
    convs = [(0, [("user", "hi"), ("assistant", "yo")]), (1, [("user", "a"), ("user", "b"), ("assistant", "c")]), (2, [("assistant", "only")]), (3, [("human", "q"), ("gpt", "a")]), (4, [("??", "q"), (None, "a")]), (5, [("system", "s"), ("user", "u")]), (6, [("user", None), ("user", ""), ("assistant", "<|im_start|>user x")]), (None, [("user", "n")])]
    got = {r["conv_id"]: r for r in format_chats(rows_of(spark, convs)).collect()}
    o, c = chat.OPEN, chat.CLOSE
    assert got[0]["rendered"] == f"{o}user\nhi{c}\n{o}assistant\nyo{c}\n" and got[0]["cost"] == 0
    assert got[1]["rendered"] == f"{o}user\na\nb{c}\n{o}assistant\nc{c}\n" and got[1]["n_merged"] == 1
    assert got[2]["rendered"] == f"{o}user\n{c}\n{o}assistant\nonly{c}\n" and got[2]["n_inserted"] == 1
    assert got[3]["cost"] == 0 and got[4]["n_relabelled"] == 2
    assert got[5]["rendered"].endswith(f"{o}assistant\n{c}\n") and got[None]["n_turns"] == 1
    assert got[6]["rendered"].count(o) == 2
    assert format_chats(rows_of(spark, convs).limit(0)).collect() == []


def test_parts_join_to_the_whole(spark):
    r = random.Random(7)
    convs = [(k, [(r.choice(["user", "assistant", "system", "x", None]), r.choice(["a", "", None, "b" * 50])) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 17, 40, 301])]
    df = rows_of(spark, convs)
    df = df.union(df.filter("conv_id = 3"))  # repeated turns
    counts = ("n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost")
    whole = {x["conv_id"]: x for x in format_chats(df).collect()}
    for most in (1, 130, 350, 5000):
        parts = format_chats(df, part_bytes=most).orderBy("conv_id", "part").collect()
        assert most > 1 or len(parts) > 300
        for k, w in whole.items():
            mine = [p for p in parts if p["conv_id"] == k]
            assert [p["part"] for p in mine] == list(range(len(mine)))
            assert "".join(p["rendered"] for p in mine) == w["rendered"]
            assert [sum(p[c] for p in mine) for c in counts] == [w[c] for c in counts]
    for w in whole.values():
        roles = [x.split("\n")[0] for x in w["rendered"].split(chat.OPEN)[1:]]
        assert len(roles) == w["rendered"].count(chat.CLOSE) == w["n_out"]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert {SYSTEM, USER, ASSISTANT} == {1, 2, 3}


def test_very_long_turns_and_null_conversation(spark):
    long = "x" * 3_000_000
    convs = [(None, [("user", long), ("assistant", long), ("user", long), ("user", "y"), (None, long)]), (5, [("bot", "a")])]
    rows = format_chats(rows_of(spark, convs)).orderBy("conv_id", "part").collect()
    mine = [x for x in rows if x["conv_id"] is None]
    assert [x["part"] for x in mine] == [0, 1, 2] and sum(x["n_turns"] for x in mine) == 5
    o, c = chat.OPEN, chat.CLOSE
    assert "".join(x["rendered"] for x in mine) == f"{o}user\n{long}{c}\n{o}assistant\n{long}{c}\n{o}user\n{long}\ny{c}\n{o}assistant\n{long}{c}\n"


def test_query_costs_equal_brute_force(spark):
    """Costs by a plain least-cost search over states, of every conversation of the table."""
    sf = "/root/testdata/sf0.001"
    turns = {}
    for x in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(x["conv_id"], []).append((x["turn"], x["role"] or "", x["text"] or ""))
    got = {}
    for x in chat.op3_query(spark, sf).collect():
        got[x["conv_id"]] = got.get(x["conv_id"], 0) + x["cost"]
    assert got.keys() == turns.keys()
    for k, some in turns.items():
        best = {START: 0}
        for _, role, text in sorted(some):
            code, after = chat.ALIASES.get(role.strip().lower(), UNKNOWN), {}
            for s, c in best.items():
                for n, at in [(0, {s})] + [(i, {t for u in ({s} if i == 1 else NEXT[s]) for t in (NEXT[u] if i else {u})}) for i in (1, 2)]:
                    for u in at:
                        for t in NEXT[u]:
                            cost = c + n * chat.INSERT + (0 if t == code else chat.RELABEL_UNKNOWN if code == UNKNOWN else chat.RELABEL)
                            after[t] = min(after.get(t, 10**9), cost)
                if s != START:
                    cost = c + (chat.MERGE_BLANK if not text.strip() else chat.MERGE_SAME if s == code else chat.MERGE_UNKNOWN if code == UNKNOWN else chat.MERGE_OTHER)
                    after[s] = min(after.get(s, 10**9), cost)
            best = after
        assert got[k] == min(c + int(END_COST[s]) for s, c in best.items()), k
