import pytest

from tripledger.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g",
        # tiny inputs: compiling each plan costs more than interpreting it
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
