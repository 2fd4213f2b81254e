import pytest

from turnloom.session import is_local, shared_folder


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(Elsewhere)


def test_local_masters():
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[2,1,512]")
