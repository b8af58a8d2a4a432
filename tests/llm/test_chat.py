from tessella.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, a int, kept int"


def brute(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is None, t or 0, r, x))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda e: e[:2])] for c, v in by.items()}
    kept = {}
    for c, v in turns.items():
        longer = any(len(o) > len(v) and o[: len(v)] == v for o in turns.values())
        same = [d for d, o in turns.items() if o == v and d is not None]
        if not longer and (c == min(same) if same else True):
            kept[c] = "".join(f"<|im_start|>{r or ''}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in v)
    return kept


def test_snapshots_and_awkward_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (2, 2, "user", "he")]
    rows += [(3, 0, "user", "hi"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "user")]
    rows += [(c, t, r, x) for c in (9, 8, 7) for t, r, x in ((0, "system", "s<|im_end|>"), (1, "user", "u"))]
    rows += [(10, 1, "user", "b"), (10, None, "user", "last"), (10, 0, "user", "a" * 200_000), (None, 0, "user", "nobody")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r.conv_id: r.text for r in chat.format_chats(frame).collect()}
    assert got == brute(rows)
    assert {r.conv_id: r.n_copies for r in chat.format_chats(frame).collect()}[7] == 3


def test_repeated_rows_and_order(spark):
    rows = [(1, 0, "user", "x")] * 2 + [(2, 0, "user", "x"), (3, 0, "user", "y"), (3, 1, "user", "x"), (4, 0, "user", "x"), (4, 1, "user", "y")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r.conv_id: r.n_turns for r in chat.format_chats(frame).collect()}
    assert got == {1: 2, 3: 2, 4: 2}


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_move_once(spark):
    """Without broadcasts, turns and kept conversations are dealt by conv_id, once each; grouping needs no more."""
    rows = [(c, t, "user", f"{c % 3} {t}", 1, 2) for c in range(30) for t in range(3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = chat.format_chats(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2 and "coalesce(conv_id" not in plan
