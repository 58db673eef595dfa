import random

from cueweave.operators.intervals import periods_and_gaps

SCHEMA = "k string, s long, e long, id long, start_ms string"


def brute(rows):
    by = {}
    for k, s, e, i, *_ in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, set()).add((s, e, i))
    out = set()
    for k, items in by.items():
        done = []
        for s, e, i in sorted(items):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
                done[-1][2].add(i)
            else:
                done.append([s, e, {i}])
        out |= {(k, "period", s, e, len(ids) > 1) for s, e, ids in done}
        out |= {(k, "gap", a[1], b[0], False) for a, b in zip(done, done[1:])}
    return out


def run(spark, rows, bucket_ms):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", "id", bucket_ms).collect()}


def test_touching_nested_and_distant(spark):
    rows = [("a", 0, 10, 1, "x"), ("a", 10, 12, 2, None), ("a", 11, 12, 3, ""), ("a", 40, 50, 4, "y")]
    assert run(spark, rows, 8) == {("a", "period", 0, 12, True), ("a", "period", 40, 50, False), ("a", "gap", 12, 40, False)}


def test_repeated_rows_nulls_and_empty(spark):
    rows = [("a", 5, 9, 1, "x")] * 3 + [("a", None, 9, 2, "x"), ("a", 9, None, 3, "x"), ("a", 9, 9, 4, "x"), (None, 1, 2, 5, "x")]
    assert run(spark, rows, 100) == {("a", "period", 5, 9, False), (None, "period", 1, 2, False)}
    assert run(spark, [], 100) == set()


def test_random_against_brute_force_with_small_buckets(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(700):
        s = rnd.randrange(4000)
        rows.append((rnd.choice(["hot", "hot", "cold", None]), s, s + rnd.choice([-3, 0, 1, 3, 9, 30, 400]), i, "t"))
    rows += rnd.sample(rows, 60)
    for width in (7, 64, 100_000):
        assert run(spark, rows, width) == brute(rows)
