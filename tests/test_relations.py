from lexmill.operators import relations


def test_closure_of_long_paths_and_cycles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(25)], "src int, dst int")
    got = {(r["src"], r["dst"]): r["hops"] for r in relations.closure(edges).collect()}
    assert len(got) == 25 * 26 // 2 and got[0, 25] == 25
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 1)], "src int, dst int")
    assert {(r["src"], r["dst"]): r["hops"] for r in relations.closure(cycle).collect()} == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2, (1, 1): 3, (2, 2): 3, (3, 3): 3}
    assert relations.closure(edges.limit(0)).count() == 0
