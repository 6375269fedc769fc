"""Clouds put together and taken apart again."""

import pytest

from lattica.operators import collate

IDS = {"nodes": {"id": "nodes", "up": "groups"}, "groups": {"id": "groups", "members": "nodes"}, "edges": {"s": "nodes", "t": "nodes"}}


def clouds(spark):
    made = []
    for n, extra in ((4, False), (0, False), (3, True)):
        nodes = [(i, i // 2, i / 10, *([f"n{i}"] if extra else [])) for i in range(n)]
        groups = [(g, [i for i in range(n) if i // 2 == g], None if g else [0]) for g in range((n + 1) // 2)]
        cloud = {
            "nodes": spark.createDataFrame(nodes, "id long, up long, x double" + (", name string" if extra else "")),
            "groups": spark.createDataFrame(groups, "id long, members array<long>, t array<long>"),
        }
        if n != 4:
            cloud["edges"] = spark.createDataFrame([(i, i + 1, 0.5) for i in range(n - 1)], "s long, t long, w double")
        made.append(cloud)
    return made


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def test_round_trip(spark):
    parts = clouds(spark)
    ids = collate.inferred(parts[2], IDS)
    # an undeclared column takes the meaning of its name; one of another kind does not
    assert ids["groups"]["t"] == "nodes" and "x" not in ids["nodes"] and "w" not in ids["edges"]
    made = collate.collated(parts, ids)
    nodes = sorted((r.batch, r.id, r.up, r.name) for r in made["nodes"].collect())
    assert nodes == [(0, i, i // 2, None) for i in range(4)] + [(2, 4 + i, 2 + i // 2, f"n{i}") for i in range(3)]
    assert sorted((r.batch, r.s, r.t) for r in made["edges"].collect()) == [(2, 4, 5), (2, 5, 6)]
    assert sorted((r.id, r.members, r.t) for r in made["groups"].collect())[2:] == [(2, [4, 5], [4]), (3, [6], None)]
    for b, part in enumerate(parts):
        back = collate.separated(made, b, ids)
        for name, df in part.items():
            assert rows(back[name].select(*df.columns)) == rows(df), (b, name)


def test_values_by_level():
    assert collate.per_level("all", 0, 1, 4, 1) == [0, 1, 1, 1] and collate.per_level("2+", 0, 1, 4) == [0, 0, 1, 1]
    assert collate.per_level("2-", 0, 1, 4) == [1, 1, 0, 0] and collate.per_level(1, 0, 1, 3) == [0, 1, 0] and collate.per_level(-1, 0, 1, 3) == [0, 0, 1]
    with pytest.raises(ValueError):
        collate.per_level("x", 0, 1, 3)
