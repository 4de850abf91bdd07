import os

import pytest

from mnemora import session


def exists(path):
    return os.path.exists(path.removeprefix("file://"))


def test_temporary_tables_are_removed(spark):
    paths = []
    a, b = session.stored(spark.range(5), "a", paths), session.stored(spark.range(7), "b")
    kept = b.inputFiles()[0]
    assert a.count() == 5 and len(paths) == 1 and exists(paths[0])
    session.remove(spark, paths)
    assert not exists(paths[0]) and exists(kept) and b.count() == 7
    session.clean(spark)
    assert not exists(kept)


def test_no_local_folder_off_a_local_master(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
