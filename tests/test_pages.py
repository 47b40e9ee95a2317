"""The source of numbered pages."""

import json

import pytest

from quadrille.sources import pages as pg

SCHEMA = "page int, id long, name string, more struct<x: int>"


@pytest.fixture()
def place(tmp_path):
    for n in range(1, 8):
        rows = [] if n == 3 else [{"id": n * 10 + i, "name": None if i == 1 else f"n{i}", "extra": 1} for i in range(3)]
        (tmp_path / f"p{n}.json").write_text(json.dumps({"pageCount": 7, "result": rows}))
    return str(tmp_path / "p%d.json")


def test_all_pages_by_several_tasks(spark, place):
    df = pg.numbered_pages(spark, place, SCHEMA, perTask=2)
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.page, r.id, r.name, r.more) for r in df.collect()) == sorted((n, n * 10 + i, None if i == 1 else f"n{i}", None) for n in (1, 2, 4, 5, 6, 7) for i in range(3))


def test_filters_reach_the_reader(spark, place):
    df = pg.numbered_pages(spark, place, SCHEMA, perTask=1)
    few = df.filter("page IN (2, 5) AND id > 20 AND name = 'n2'")
    assert few.rdd.getNumPartitions() == 2 and sorted(r.id for r in few.collect()) == [22, 52]
    assert df.filter("page > 9").count() == 0 and df.filter("name IS NULL").count() == 6 and df.filter("name <> 'n0' OR id = 10").count() == 7


def test_pages_that_are_folders_and_other_keys(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"page={n}").mkdir()
        for i in range(2):
            (tmp_path / f"page={n}" / f"part-{i}").write_text(json.dumps({"total": 2, "rows": [{"id": 2 * n + i}]}))
        (tmp_path / f"page={n}" / "_SUCCESS").write_text("")
    df = pg.numbered_pages(spark, f"file://{tmp_path}/page=%d", "id long", items="rows", count="total", first=0)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3]


def test_a_missing_page_fails(spark, place, tmp_path):
    (tmp_path / "p4.json").unlink()
    with pytest.raises(Exception, match="p4.json|FileNotFound"):
        pg.numbered_pages(spark, place, SCHEMA).collect()
