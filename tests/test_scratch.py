"""Where intermediate tables go."""

import os

import pytest

from dayweave.sources import materialize, scratch_folder, scratch_space


class Session:
    """What `scratch_folder` asks of a session."""

    def __init__(self, master, directory=None, conf=None):
        self.sparkContext = self
        self.master, self.directory = master, directory
        self.conf = {"spark.checkpoint.dir": conf} if conf else {}

    def getCheckpointDir(self):
        return self.directory


def test_the_argument_decides_then_the_checkpoint_directory_then_the_setting():
    assert scratch_folder(Session("yarn", "/b", "/c"), "/a/") == "/a"
    assert scratch_folder(Session("yarn", "/b", "/c")) == "/b"
    assert scratch_folder(Session("yarn", None, "/c")) == "/c"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError):
        scratch_folder(Session(master))


def test_a_local_run_gets_a_folder():
    assert os.path.isdir(scratch_folder(Session("local[2]")))


def test_the_tables_of_a_job_go_with_it(spark, tmp_path):
    with scratch_space(spark, "job", str(tmp_path)) as space:
        assert materialize(spark.range(3), "t", space).count() == 3
        assert os.listdir(tmp_path)
    assert not [x for x in os.listdir(tmp_path) if not x.endswith(".crc")]
