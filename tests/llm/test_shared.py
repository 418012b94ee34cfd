from types import SimpleNamespace

import pytest

from orbweave.llm.shared import checkpoint_root


def test_no_machine_local_folder_on_a_cluster():
    kept = {}
    conf = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: {"spark.master": master}.get(k, d), set=kept.__setitem__))
    with pytest.raises(RuntimeError):
        checkpoint_root(conf("spark://host:7077"))
    assert not kept and checkpoint_root(conf("local[2]")).startswith("file://") and "spark.checkpoint.dir" in kept
