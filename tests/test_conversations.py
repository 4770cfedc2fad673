from corpusloom.operators import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_pairs(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"),
        (1, 4, "user", " \n"), (1, 5, "assistant", "a?"), (1, 6, "user", "open"),
        (2, 0, "user", "q"), (2, 5, "assistant", ""),
    ]
    for block in (2, 4096):
        got = C.pairs(spark.createDataFrame(rows, SCHEMA), block).collect()
        assert {(r["conv_id"], r["turn"], r["message"], r["response"]) for r in got} == {(1, 2, "q2", "a2"), (2, 0, "q", "")}


def test_tail_and_history(spark):
    rows = [(1, t, "human" if t % 2 else "assistant", f"m{t}" + "x" * 300) for t in range(25)] + [(2, 3, "user", "hi")]
    messages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    tail = C.tail(messages).orderBy("conv_id", "position").collect()
    assert [r["turn"] for r in tail] == [*range(15, 25), 3]
    assert [r["position"] for r in tail] == [*range(1, 11), 1]
    assert tail[0]["line"] == "🧑 Human: " + ("m15" + "x" * 300)[:200] + "..."
    assert tail[-1]["line"] == "🧑 User: hi..."
    assert [r["turn"] for r in C.history(messages, 1).collect()] == list(range(25))
