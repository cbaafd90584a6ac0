from types import SimpleNamespace

import pytest

from kinelake import session


def bare(master, app="app-1"):
    """What the folder is found by, with ``spark.checkpoint.dir`` unset."""
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_an_unset_folder_is_made_once_in_local_mode():
    one, two = session.shared_root(bare("local[4]")), session.shared_root(bare("local"))
    assert one == two and one.startswith("file:///")
    assert session.shared_root(bare("local[2]", "app-2")) != one
    assert session.shared_path(bare("local[4]"), "x") != session.shared_path(bare("local[4]"), "x")


def test_an_unset_folder_is_refused_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_root(bare(master))
