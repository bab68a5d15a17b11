import time

import pytest
from pyspark.sql import functions as F

from postpulse.session import shared_dir, shuffles_dropped


class Session:
    """What ``shared_dir`` looks at in a session."""

    def __init__(self, master, base=None):
        self.sparkContext = self
        self.master, self.base = master, base
        self.conf = self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.base or default


def test_shared_folder_is_below_the_setting():
    assert shared_dir(Session("yarn", "store://x/"), "a").startswith("store://x/a-")


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_without_the_setting_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(master), "a")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_session_takes_a_folder_of_its_own(master):
    assert shared_dir(Session(master), "a") != shared_dir(Session(master), "a")


def test_files_of_shuffles_go_with_the_query(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key, None)
    rows = spark.range(0, 1_000, 1, 4).groupBy(F.col("id") % 7).count()
    rows.write.parquet(f"{tmp_path}/kept")
    assert shuffled() - before
    before = shuffled()
    with shuffles_dropped(spark):
        rows.write.parquet(f"{tmp_path}/dropped")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(key, None) == setting
    assert spark.read.parquet(f"{tmp_path}/dropped").count() == 7
