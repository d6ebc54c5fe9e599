import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Workers import the package and the functions of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chronoscribe.session import build_session
    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="3", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        # Tests ask for figures of their stages, which a long session would have dropped.
        spark__ui__retainedStages="100000", spark__ui__retainedJobs="100000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
