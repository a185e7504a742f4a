import pytest

from quern import session


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(FakeSession)
