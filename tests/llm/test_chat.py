from noticelake.llm import chat


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_fold_of_events(spark):
    events = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "message", "assistant", "He"),
        (1, 2, 3, "delta", None, "ll"),
        (1, 2, 5, "delta", None, "!"),
        (1, 2, 4, "delta", None, "o"),
        (1, 2, 6, "regenerate", None, None),
        (1, 2, 7, "delta", None, "Good"),
        (1, 2, 8, "delta", None, " day"),
        (1, 3, 9, "message", "user", "bye"),
        (1, 1, 10, "edit", None, "hello"),
        (1, 4, 11, "message", "assistant", "gone"),
        (1, 4, 12, "delete", None, None),
        (2, 1, 1, None, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "Good day"), (1, 3): ("user", "bye"), (2, 1): ("", "")}


TEXTS = ["", " ", "[INST]", "[\\INST]", "[\\\\/INST] x", "</s>[INST] ok [/INST]", "<s><s>", "[[INST]]", "<\\s>", "a [/SYS]", "é [AS] </s", "[TURN", " [/INST]", "[ANS] [TURN] x [AS] y [/TURN]"]


def test_template_is_reversible(spark):
    turns = [(i, j, role, text) for i, role in enumerate(["system", "user", "assistant", "tool [AS] x", "", "</s>"]) for j, text in enumerate(TEXTS)]
    df = spark.createDataFrame(turns, "conv_id long, message_id long, role string, text string")
    out = chat.render(df)
    read = out.select("conv_id", chat.read_turns(out["formatted"]).alias("turns"), "formatted", "loss_spans").collect()
    for r in read:
        want = [(t[2], t[3]) for t in turns if t[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert len(r.loss_spans) == (len(TEXTS) if want[0][0] == "assistant" else 0)
        assert r.formatted.count("<s>") == 1
    spans = chat.digests(out).collect()
    got = {r.conv_id: r.loss_chars for r in spans}
    assert got[2] == sum(map(len, TEXTS)) and got[0] == 0


def test_rows_with_nulls_ties_and_repeats(spark):
    t = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.as_events(df)))).collect()}
    assert got[1].n_turns == 3 and got[2].loss_chars == 2
    assert chat.render(chat.fold(chat.as_events(df.limit(0)))).collect() == []


def test_streamed_logs_fold_to_their_messages(spark):
    t = [(1, 0, "user", None), (1, 1, "assistant", "an answer é"), (1, 2, None, "x"), (1, 3, "assistant", ""), (2, 0, "assistant", None)]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' as kind", "1 as seq", "2 as message_id")
    log = chat.as_streamed(chat.as_events(df))
    assert {r.kind for r in log.collect()} == {"message", "delta", "regenerate", "edit"}
    want = sorted((r.conv_id, r.message_id, r.role, r.text) for r in chat.fold(chat.as_events(df)).collect())
    assert sorted((r.conv_id, r.message_id, r.role, r.text) for r in chat.fold(log).collect()) == want


def test_query_adds_its_own_conversation(spark, sf):
    got = {r.conv_id: r for r in chat.op2_chat(spark, sf).collect()}
    assert (got[-7].n_turns, got[-7].loss_chars) == (2, 21)
    assert len(got) == 1 + spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
