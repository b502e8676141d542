from types import SimpleNamespace

import pytest

from weftline.llm import common


def session(master, checkpoints, warehouse):
    conf = {"spark.checkpoint.dir": checkpoints, "spark.sql.warehouse.dir": warehouse}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf[key] or default))


def test_folder_for_checkpoints():
    assert common.shared_dir(session("spark://host:1", "/shared", "file:/w")) == "/shared"
    assert common.shared_dir(session("spark://host:1", None, "hdfs://name/w")) == "hdfs://name/w/_checkpoints"
    assert common.shared_dir(session("local[8]", None, "file:/w")) == "file:/w/_checkpoints"
    with pytest.raises(ValueError, match="shared folder"):
        common.shared_dir(session("spark://host:1", None, "file:/w"))
