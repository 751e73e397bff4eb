"""Commits of several tables at once, and readers bound to a version."""

import pytest
from pyspark.sql import functions as F

from scorelake.session import shared_dir
from scorelake.sources import writers as W
from scorelake.sources.versions import CommitConflict, TableGroup


@pytest.fixture()
def group(spark):
    return TableGroup(spark, shared_dir(spark, "versions"))


def parents(spark, ids, tag):
    return spark.createDataFrame([(i, tag) for i in ids], "id long, tag string")


def children(spark, ids, tag):
    return spark.createDataFrame([(i, f"{tag}{k}") for i in ids for k in range(2)], "pid long, name string")


def found(group, table, version=None):
    return sorted(map(tuple, group.read(table, version).collect()), key=str)


def load(spark, group, ids, tag, **options):
    return group.replace({"p": (parents(spark, ids, tag), "id", None), "c": (children(spark, ids, tag), "pid", None)}, buckets=8, **options)


def test_versions_replace_by_key_and_stay_readable(spark, group):
    first = load(spark, group, range(20), "a")
    second = group.replace({"p": (parents(spark, [3, 4], "b"), "id", None), "c": (children(spark, [3], "b"), "pid", spark.createDataFrame([(3,), (4,)], "id long"))})
    assert (first, second, group.newest()) == (1, 2, 2)
    assert found(group, "p", 1) == sorted([(i, "a") for i in range(20)], key=str)
    assert found(group, "p") == sorted([(i, "b" if i in (3, 4) else "a") for i in range(20)], key=str)
    assert found(group, "c") == sorted([(i, f"{'b' if i == 3 else 'a'}{k}") for i in range(20) if i != 4 for k in range(2)], key=str)
    before, after = group.states(1)["p"].folders, group.states(2)["p"].folders
    assert len(set(before.values()) & set(after.values())) >= 6


@pytest.mark.parametrize("place", ["second table", "manifest"])
def test_killed_half_way_readers_see_the_old_version(spark, group, monkeypatch, place):
    load(spark, group, range(10), "a")
    reader = group.read("c")
    if place == "manifest":
        monkeypatch.setattr(group.files, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        bad = children(spark, [1], "x")
    else:
        bad = children(spark, [1], "x").withColumn("name", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        group.replace({"p": (parents(spark, [1], "x"), "id", None), "c": (bad, "pid", None)})
    monkeypatch.undo()
    assert group.newest() == 1 and found(group, "p") == [(i, "a") for i in range(10)]
    assert found(group, "c") == sorted(map(tuple, reader.collect()), key=str)
    # The same commit again goes through, and what the killed one left is removed.
    assert load(spark, group, [1], "x") == 2 and (1, "x") in found(group, "p")
    left = group.vacuum(keep=2)
    assert left and found(group, "p", 1) == [(i, "a") for i in range(10)]
    assert group.vacuum(keep=1) and group.versions() == [2] and len(found(group, "c")) == 20 and group.vacuum(keep=1) == []


def test_a_slower_writer_fails_and_changes_nothing(spark, group):
    load(spark, group, range(4), "a")
    assert load(spark, group, [1], "fast") == 2
    with pytest.raises(CommitConflict):
        load(spark, group, [1], "slow", based_on=1)
    assert (1, "fast") in found(group, "p") and group.newest() == 2
    # Both saw no newer version; the name of the manifest decides.
    assert not group.files.publish("{}", "_versions", f"{2:012d}.json") and found(group, "p")


def test_cases(spark, group):
    with pytest.raises(KeyError):
        group.read("p")
    rows = spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (2, None)], "id long, tag string")
    group.replace({"p": (rows, "id", None)}, buckets=4)
    assert len(found(group, "p")) == 4
    group.replace({"p": (spark.createDataFrame([(None, "new")], "id long, tag string"), "id", None)})
    assert found(group, "p") == sorted([(None, "new"), (1, "a"), (1, "a"), (2, None)], key=str)
    group.replace({"p": (rows.limit(0), "id", rows.select("id"))})
    assert found(group, "p") == [] and group.read("p").columns == ["id", "tag"]
    group.replace({"p": (rows, "id", None)})
    group.rebucket("p", 16)
    assert group.states()["p"].buckets == 16 and len(found(group, "p")) == 4
    with pytest.raises(ValueError):
        group.replace({"p": (rows, "tag", None)})


def test_plates_and_children_change_together(spark):
    folder = shared_dir(spark, "plates")
    make = lambda ids, tag: {
        "plates": parents(spark, ids, tag), **{n: children(spark, ids, tag).withColumnRenamed("pid", "plate_id") for n in ("stocks", "industrial_chains", "question_answers")}}
    assert W.upsert_plates(spark, folder, make(range(5), "a")) == 1
    new = make([2], "b")
    assert W.upsert_plates(spark, folder, {**new, "stocks": new["stocks"].limit(0)}) == 2
    tables = W.read_plates(spark, folder)
    assert sorted(tables) == ["industrial_chains", "plates", "question_answers", "stocks"]
    assert tables["stocks"].where("plate_id = 2").count() == 0 and tables["question_answers"].where("plate_id = 2 and name like 'b%'").count() == 2
    assert W.read_plates(spark, folder, 1)["stocks"].where("plate_id = 2").count() == 2
