from groundmill.llm import quotes as Q

M = [
    (1, 0, "user", "How do I sort a list in place?\n\nThanks a lot."),
    (1, 1, "assistant", "Use the sort method.\nIt is stable and quick."),
    (1, 2, "user", "On Monday, Bot wrote:\n> Use the sort method.\n>> How do I sort a list in place?\nDoes it copy the list?"),
    (1, 3, "assistant", "> how do I SORT a   list in place?\n\nAnother answer to that."),
    (1, 4, "user", "no quote here"),
    (2, 0, "user", "> Another answer to that.\nfrom another thread"),
    (2, 1, "user", "> nobody ever wrote this line\nok"),
    (3, 0, "user", None), (3, 0, "user", None), (3, 5, "user", ""), (None, 1, "user", "> Use the sort method."), (4, None, "x", "t"),
]


def test_parse():
    body, found = Q.parse(M[2][3])
    assert body == "Does it copy the list?" and found == [(1, "Use the sort method."), (2, "How do I sort a list in place?")]
    assert Q.parse("a > b\n-> c") == ("a > b\n-> c", []) and Q.parse("") == ("", []) and Q.parse("> > x y")[1] == [(2, "x y")]


def test_links_and_threads(spark):
    df = spark.createDataFrame([(*m, "z") for m in M], "conv_id long, turn long, role string, text string, body string")
    rows = Q.link_quotes(df).collect()
    assert len(rows) == len(M)
    got = {(r.conv_id, r.turn): r for r in rows}
    assert (got[1, 2].reply_turn, got[1, 2].linked, got[1, 2].n_quotes) == (1, True, 2)
    assert (got[1, 3].reply_turn, got[1, 3].linked, got[1, 3].body) == (0, True, "Another answer to that.")
    assert (got[1, 4].reply_turn, got[1, 4].linked) == (3, False)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].linked) == (1, 3, True)
    assert (got[2, 1].reply_conv, got[2, 1].reply_turn, got[2, 1].linked) == (2, 0, False)
    assert [got[1, t].thread_turn for t in range(5)] == [0] * 5 and [got[1, t].depth for t in range(5)] == [0, 1, 2, 1, 2]
    assert got[3, 5].reply_turn is None and got[3, 5].thread_turn == 5 and got[None, 1].reply_turn is None
    assert Q.link_quotes(df.limit(0)).count() == 0


def test_long_chain_and_hot_message(spark):
    rows = [(7, t, "user", "the very same text") for t in range(40)] + [(c, 0, "user", "the very same text") for c in range(100, 400)]
    rows += [(c, 1, "user", "> the very same text\nhm") for c in range(100, 400)]
    got = Q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.count() == len(rows)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert by[7, 39].depth == 39 and by[7, 39].thread_turn == 0
    assert all(by[c, 1].reply_conv == c and by[c, 1].linked for c in range(100, 400))


def test_the_least_original_is_in_the_quoting_conversation(spark):
    rows = [(1, 0, "u", "> a line of two conversations\nwhat is it"), (1, 1, "u", "a line of two conversations"), (2, 5, "u", "a line of two conversations"), (3, 6, "u", "a line of two conversations")]
    got = {(r.conv_id, r.turn): r for r in Q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].reply_conv, got[1, 0].reply_turn, got[1, 0].linked) == (2, 5, True)


def test_trimmed_and_wrapped_quotes(spark):
    long = "Sorting is stable. The method sorts in place and it takes no copy. It runs in linear time on sorted lists.\n\nAsk again if unsure."
    rows = [
        (1, 0, "u", "How do I sort?"), (1, 1, "a", long), (1, 2, "u", "no quote"),
        (1, 3, "u", "> The method sorts in place and it takes no copy.\nsure?"),
        (1, 4, "u", "> takes no copy. It runs in\n> linear time on\n> sorted lists.\nreally?"),
        (1, 5, "u", "> Sorting is stable.\n>\n> Ask again if unsure.\nok"),
        (1, 6, "u", "> method sorts in place but it takes no copy\nno"),
        (1, 7, "u", ">> Ask again\n>> if unsure.\n> nobody wrote this here\nwell"),
        (2, 0, "u", "> RUNS in  linear time\nfrom afar"), (2, 1, "u", "Ask again if"), (2, 2, "u", "> if Ask again if unsure"),
    ]
    rows += [(c, 0, "u", f"this is a long line of conversation {c}. with a second part") for c in range(10, 60)]
    rows += [(c, 2, "u", f"> conversation {c}. with a second\nhm") for c in range(10, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn, r.linked) for r in Q.link_quotes(df).collect()}
    assert [got[1, t] for t in (3, 4, 5, 7)] == [(1, 1, True)] * 4 and got[1, 6] == (1, 5, False)
    assert got[2, 0] == (1, 1, True) and got[2, 2] == (2, 1, False)  # no run of words of one message
    assert all(got[c, 2] == (c, 0, True) for c in range(10, 60))


def walk(got):
    """Places by force: each thread walked through its replies."""
    want = {}
    for c, t in got:
        if got[c, t].reply_turn is None or got[c, t].reply_conv != c:
            todo, n = [t], 0
            while todo:
                x = todo.pop()
                want[c, x] = (t, n)
                n += 1
                todo += sorted((b for a, b in got if a == c and got[a, b].reply_conv == c and got[a, b].reply_turn == x), reverse=True)
    return want


def test_reply_order_and_conversations(spark):
    import random

    r, rows = random.Random(5), []
    for c in range(12):
        lines = [f"message {t} of {c} says {r.random()}" for t in range(r.choice([1, 2, 9, 30]))]
        for t, line in enumerate(lines):
            quote = f"> {lines[r.randrange(t)]}\n" if t and r.random() < 0.6 else ""
            rows.append((c, t, "user" if t % 2 else "bot", quote + line))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = Q.link_quotes(df)
    got = {(x.conv_id, x.turn): x for x in linked.collect()}
    assert {k: (x.thread_turn, x.position) for k, x in got.items()} == walk(got)
    said = {(c, t): (role, text.split("\n")[-1]) for c, t, role, text in rows}
    for x in Q.conversations(linked, 8).collect():
        order = sorted((p, t) for (c, t), (top, p) in walk(got).items() if c == x.conv_id and top == x.thread_turn)
        assert [(m.role, m.body) for m in x.messages] == [said[x.conv_id, t] for _, t in order][x.part * 8 : x.part * 8 + 8]


def test_links_of_drawn_quotes_equal_brute_force(spark):
    from groundmill.llm import registry

    d = "/root/testdata/sf0.001"
    asked = Q.with_quotes(registry.table(spark, d, "conversations")).collect()
    got = {(r.conv_id, r.turn): r for r in registry.QUERIES["op7_quotes"](spark, d).collect()}
    words = {(m.conv_id, m.turn): f" {' '.join(Q.parse(m.text or '')[0].lower().split())} " for m in asked}
    linked = 0
    for m in asked:
        passages = Q.parse(m.text or "")[1]
        if passages:
            quote = f" {Q.normal(passages[0][1])} "
            same = sorted(t for c, t in words if c == m.conv_id and t < m.turn and quote in words[c, t])
            assert got[m.conv_id, m.turn].linked and got[m.conv_id, m.turn].reply_turn == same[0] and got[m.conv_id, m.turn].reply_conv == m.conv_id
            linked += 1
    assert linked > 5
