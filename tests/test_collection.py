import pytest

from docloom.errors import InvalidInput
from docloom.operators.collection import Collection, patch


def rows(spark, *items):
    return spark.createDataFrame([(i, t, (v, i)) for i, t, v in items], "unit_id string, content string, meta struct<level: string, n: string>")


def contents(c):
    return {r.unit_id: r.content for r in c.rows.collect()}


@pytest.mark.parametrize("kind", ["memory", "local"])
def test_life(spark, tmp_path, kind):
    first = rows(spark, ("a", "1", "x"), ("b", "2", "y"))
    c = Collection.in_memory(first) if kind == "memory" else Collection.local(spark, str(tmp_path / "c"))
    if kind == "local":
        with pytest.raises(InvalidInput):
            _ = c.rows
        c.add(first)
    c.upsert(rows(spark, ("b", "3", "y"), ("c", "4", "z")))
    assert contents(c) == {"a": "1", "b": "3", "c": "4"}
    c.update(rows(spark, ("c", "5", "z"), ("d", "6", "z")))
    assert contents(c) == {"a": "1", "b": "3", "c": "5"}
    assert [r.unit_id for r in c.get(["c", "zz", "a"]).collect()] == ["c", "a"]
    c.patch({"unit_id": "a"}, {"meta.level": "new"})
    assert {r.unit_id: r.meta.level for r in c.rows.collect()} == {"a": "new", "b": "y", "c": "z"}
    assert c.count({"meta.level": {"$in": ["new", "z"]}}) == 2
    c.delete(rows(spark, ("a", "", "")))
    c.remove({"content": "3"})
    assert contents(c) == {"c": "5"} and c.exists("c") and not c.exists("a")
    with pytest.raises(InvalidInput):
        c.remove({})
    c.clear()
    assert c.count() == 0


def test_patch_leaves_other_rows(spark):
    got = patch(rows(spark, ("a", "1", "x"), ("b", "2", "y")), {"unit_id": "b"}, {"content": "9"})
    assert {r.unit_id: r.content for r in got.collect()} == {"a": "1", "b": "9"}


def test_vectors_of_several_lengths_raise(spark):
    c = Collection.in_memory(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), "vec_id")
    with pytest.raises(InvalidInput):
        c.dimension()


def test_servers_are_not_there(spark):
    with pytest.raises(NotImplementedError):
        Collection.server("host")
