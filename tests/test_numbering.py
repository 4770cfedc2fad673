import random

from corpusloom.operators.numbering import running_start, with_next


def test_running_start_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if n % 3 else f"g{n % 7}", n * 7919 % 5003, rng.randint(0, 4)) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, o bigint, w bigint").repartition(6)
    got = running_start(df, ["o"], ["g"], "w").collect()
    expected, sums = {}, {}
    for g, o, w in sorted(rows):
        expected[g, o] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + w
    assert {(r["g"], r["o"]): r["start"] for r in got} == expected


def test_running_start_over_all_rows_with_ties(spark):
    rows = [(float(n % 5 == 0), n) for n in range(500)]
    df = spark.createDataFrame(rows, "v double, id bigint")
    got = running_start(df, ["v", "id"]).collect()
    order = {pair: at for at, pair in enumerate(sorted(rows))}
    assert {(r["v"], r["id"]): r["start"] for r in got} == order


def test_with_next_crosses_blocks_and_gaps(spark):
    rows = [(c, t, f"{c}-{t}") for c in (1, 2, 3) for t in [0, 1, 2, 5, 6, 40, 41, 99][: 2 + 3 * (c - 1)]]
    rows.append((4, 7, "alone"))
    rows.extend((None, t, f"none-{t}") for t in (0, 5, 6))
    df = spark.createDataFrame(rows, "c int, t int, x string")
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        for a, b in zip(own, own[1:] + [None]):
            expected[a[0], a[1]] = b[2] if b else None
    for block in (1, 2, 3, 4096):
        got = with_next(df, "c", "t", ["x"], block).collect()
        assert {(r["c"], r["t"]): r["next"]["x"] if r["next"] else None for r in got} == expected


def test_rows_without_a_group_are_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, o bigint")
    got = running_start(df, ["o"], ["g"]).collect()
    assert {(r["g"], r["o"]): r["start"] for r in got} == {(None, 1): 0, (None, 2): 1, ("a", 3): 0}
