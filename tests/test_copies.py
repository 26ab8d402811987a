import random

from lexmill.operators import copies


def brute(rows):
    codes = copies.Codes()
    sets = {k: set(copies.shingles(t, codes).tolist()) for k, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    label = {k: k for k in sets}
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return sets, near, label


def test_near_copies_equal_brute_force(spark):
    r = random.Random(3)
    phrases = [" ".join(f"w{r.randrange(60)}" for _ in range(9)) for _ in range(25)]
    rows = []
    for k in range(60):
        words = " ".join(r.choices(phrases, k=r.randrange(1, 22))).split()
        for v in range(r.randrange(1, 5)):
            rows.append((f"{k:03}-{v}", " ".join(words)))
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randrange(9)}"
    rows += [("e1", ""), ("e2", None), ("s1", "Un bail."), ("s2", "un bail"), ("s3", "deux baux")]
    r.shuffle(rows)
    sets, near, label = brute(rows)
    assert sum(sets[a] != sets[b] for a, b in near) > 20
    got = {x["chunk_id"]: x for x in copies.near_copies(spark.createDataFrame(rows + rows[:9], "chunk_id string, text string").repartition(3), "chunk_id", "text").collect()}
    assert len(got) == len(rows) and {k: x["class_id"] for k, x in got.items()} == label
    first = {k: min(j for j in sets if sets[j] == sets[k]) if sets[k] else k for k in sets}
    for k, x in got.items():
        if first[k] != k:
            assert [tuple(y) for y in x["links"]] == [(first[k], 1.0)]
        else:
            assert [y["chunk_id"] for y in x["links"]] == sorted(j for j in sets if first[j] == j and tuple(sorted((j, k))) in near)


def test_copies_in_other_documents_and_places(spark):
    text = " ".join(f"mot{k}" for k in range(60))
    rows = [("a", "d1", 0, text), ("b", "d1", 2, text.replace("mot59", "fin")), ("c", "d2", 0, text), ("d", "d3", 0, "tout autre texte sans rien de commun ici")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_index int, text string")
    assert {x[0]: x[1] for x in copies.near_copies(df, "chunk_id", "text").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 80)], "a long, b long")
    assert {x[0]: x[1] for x in copies.components(edges).collect()} == {k: 0 for k in range(41)} | {80: 80, 90: 80}
