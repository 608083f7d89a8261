"""The scratch folder of an application."""

import subprocess
import sys
from pathlib import Path

import pytest

from dockflow import session

SCRIPT = """
import sys
from dockflow.session import build_session, settle
spark = build_session(master="local[1]", spark__ui__enabled="false", **({"spark__checkpoint__dir": sys.argv[1]} if sys.argv[1:] else {}))
assert settle(spark.range(5)).count() == 5
print("FOLDER", __import__("dockflow.session").session.shared_root(spark))
"""


@pytest.mark.parametrize("given", [True, False])
def test_nothing_is_left_behind(tmp_path, given):
    args = [str(tmp_path / "shared")] if given else []
    root = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", SCRIPT, *args], cwd=root, capture_output=True, text=True, timeout=120)
    folder = done.stdout.split("FOLDER ")[1].strip()
    assert folder.startswith(str(tmp_path)) == given and not Path(folder).exists()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "yarn", "app-without-folder"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_passing_tables_go_and_those_that_stay_are_left(spark):
    folder = Path(session.shared_root(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    with session.passing(spark):
        session.settle(spark.range(3))
        kept = session.settle(spark.range(5), stays=True)
        with pytest.raises(ValueError), session.passing(spark):
            session.settle(spark.range(4))
            raise ValueError
        assert len(set(folder.iterdir()) - before) == 2
    assert len(set(folder.iterdir()) - before) == 1 and kept.count() == 5
    session.settle(spark.range(6))
    assert len(set(folder.iterdir()) - before) == 2
