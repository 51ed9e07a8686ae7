"""The session leaves master and partitions to the launcher and never makes up a cluster's storage."""
import pytest

from freightline import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class Session:
    def __init__(self, master, conf):
        self.sparkContext, self.conf = Context(master), self
        self.values = dict(conf)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session(master, {}))


def test_the_named_folder_is_used():
    s = Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.ensure_checkpoint_dir(s) == "hdfs:///shared"
    assert session.scratch_path(s, "x").startswith("hdfs:///shared/x-")


def test_a_local_session_gets_a_folder():
    s = Session("local[4]", {})
    assert session.ensure_checkpoint_dir(s) == s.get("spark.checkpoint.dir")


def test_partitions_are_the_launchers(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.get_session()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
