"""Intermediate tables: kept ones stay, those of a finished step go."""

import os

import pytest

from tessera.sources.scratch import saved, temporary


def _path(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_temporary_tables_are_removed(spark):
    before = saved(spark.range(3), "outer")
    with temporary(spark):
        gone = saved(spark.range(5), "inner")
        with temporary(spark):
            nested, result = saved(gone, "nested"), saved(gone.selectExpr("id * 2 AS id"), "result", keep=True)
            paths = [_path(d) for d in (nested, gone)]
        assert not os.path.exists(paths[0]) and os.path.exists(paths[1])
        kept = saved(result, "kept", keep=True)
        paths.append(_path(result))
    assert not any(os.path.exists(p) for p in paths)
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8] and before.count() == 3
    with pytest.raises(ZeroDivisionError), temporary(spark):
        path = _path(saved(spark.range(1), "failed"))
        1 // 0
    assert not os.path.exists(path)
