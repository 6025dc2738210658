from verdigris.llm.queries import QUERIES
from verdigris.llm.quotations import conversations, parse


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, thread int")
    return {(r.conv_id, r.turn): r for r in conversations(df, **kw).collect()}


def test_nested_levels_become_passages(spark):
    text = "Yes.\r\nOn Monday, Ann wrote:\n> I think so too.\n> > Is it\n>> so, really?\n> Good.\nBye > now"
    own, passages = parse(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), ["conv_id", "turn"])
    assert [r.own for r in own.collect()] == ["Yes.\nBye > now"]
    assert sorted((r.level, r.passage) for r in passages.collect()) == [(1, "Good."), (1, "I think so too."), (2, "Is it\nso, really?")]


def test_links_within_and_between_conversations(spark):
    rows = [
        (1, 0, "user", "The first message, here."), (1, 1, "assistant", "An answer to it all."), (1, 2, "user", "> the FIRST message here\nBack to this."),
        (2, 0, "user", "> An answer to\n> it all!\n\nNew conversation."), (2, 1, "assistant", "Right."),
        (3, 0, "user", "> not said by anyone\nAlone."), (4, 0, "user", "> Right.\nToo short to link."),
    ]
    got = run(spark, rows)
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 0), (2, 0): (1, 1), (2, 1): (2, 0), (3, 0): (None, None), (4, 0): (None, None)}
    assert got[2, 0].text == "New conversation." and got[1, 2].text == "Back to this." and got[2, 0].n_quotes == 1
    assert [k for k, r in sorted(got.items(), key=lambda x: (x[1].thread, x[1].depth, x[0]))] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 0)]
    assert [got[k].depth for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1))] == [0, 1, 1, 2, 3]
    assert {r.thread for k, r in got.items() if k[0] < 3} == {1}


def test_nested_interleaved_trimmed_short_and_unspaced_quotes(spark):
    rows = [
        (1, 0, "user", "What is the plan for today?"), (1, 1, "assistant", "First some words.\n> What is the plan for today?\nThen some others."),
        (1, 2, "user", "Nothing quoted."), (1, 3, "assistant", "> First some words.\n> > What is the plan for today?\n> Then some others.\nAll of it quoted."),
        (1, 4, "user", "One paragraph of text.\n\nAnother paragraph of text.\n\nYes."), (1, 5, "assistant", "Between."),
        (1, 6, "user", "> Another paragraph of text.\nOnly that."), (1, 7, "assistant", "> One paragraph of text.\nA.\n> Yes.\nB."), (1, 8, "user", "> Between.\nShort."),
        (2, 0, "user", "今天我们做什么"), (3, 0, "user", "> 今天我们做什么\n好的"),
        (4, 0, "user", "> Then some others.\nOutside."),
        (5, 0, "user", "> First some words.\n>\n> Then some others.\nOutside, whole."),
    ]
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in run(spark, rows).items()}
    assert parent[1, 1] == (1, 0) and parent[1, 3] == (1, 1)
    assert parent[1, 6] == parent[1, 7] == (1, 4) and parent[1, 8] == (1, 5)
    assert parent[3, 0] == (2, 0) and parent[4, 0] == parent[5, 0] == (1, 1)


def test_a_long_chain_is_in_reply_order(spark):
    got = run(spark, [(9, t, "user", f"message number {t}") for t in range(40)])
    assert [got[9, t].depth for t in range(40)] == list(range(40))


def test_nulls_repeats_and_empty_tables(spark):
    got = run(spark, [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ""), (None, 0, "user", "x"), (1, None, "user", "x"), (2, 5, "user", "> > >"), (3, 0, "user", "same words as these"), (3, 0, "user", "same words as those")])
    assert set(got) == {(1, 0), (1, 1), (2, 5), (3, 0)}
    assert got[1, 0].text == "" and got[2, 5].text == "" and got[2, 5].n_quotes == 1 and got[3, 0].text == "same words as these"
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations(df).count() == 0


def test_query_keeps_every_message(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op2_quotations"](spark, sf).collect()
    want = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn) for r in got} == want and len(got) == len(want)
