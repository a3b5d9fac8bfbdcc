"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from cinderlog.sources import workspace


def session(master, conf=None, checkpoint=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint),
    )


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(session(master))
    assert workspace.shared_folder(session(master, conf="hdfs:///shared/")) == "hdfs:///shared"
    assert workspace.shared_folder(session(master, checkpoint="hdfs:///kept")) == "hdfs:///kept"


def test_one_machine_gets_a_folder_of_the_process():
    first = workspace.shared_folder(session("local[4]"))
    assert first == workspace.shared_folder(session("local"))


def test_written_tables_are_released(spark):
    frame = workspace.written(spark.range(10), "numbers")
    assert frame.count() == 10
    path = workspace._MADE[-1]
    assert path.startswith(workspace.shared_folder(spark))
    kept, workspace._MADE[:] = workspace._MADE[:-1], [path]
    try:
        assert workspace.release(spark) == 1
    finally:
        workspace._MADE[:] = kept
