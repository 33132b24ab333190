from types import SimpleNamespace

import pytest

from lakeprobe.session import ensure_checkpoint_dir


def _session(master, setting=None, folder=None):
    conf, context = {"spark.checkpoint.dir": setting}, SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda p: setattr(context, "folder", p)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf[k] or d, set=conf.__setitem__))


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(_session(master))


def test_the_setting_and_the_context_are_honoured():
    s = _session("yarn", setting="hdfs:///shared")
    assert ensure_checkpoint_dir(s) == "hdfs:///shared" and s.sparkContext.folder == "hdfs:///shared"
    assert ensure_checkpoint_dir(_session("yarn", folder="hdfs:///own")) == "hdfs:///own"


def test_one_process_takes_a_scratch_folder():
    s = _session("local[2]")
    assert ensure_checkpoint_dir(s) == s.sparkContext.folder
