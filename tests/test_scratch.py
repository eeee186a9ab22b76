"""Scratch folders: local sessions may fall back to a local one, clusters may not."""

from types import SimpleNamespace

import pytest

from assay.scratch import scratch_path


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(session(master), "x")
    assert scratch_path(session(master, "s3a://b/c/"), "x").startswith("s3a://b/c/assay-x-")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_session_may_leave_it_out(master):
    assert "assay-x-" in scratch_path(session(master), "x")
