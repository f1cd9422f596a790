import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pageloom.session import local_session, ship

    session = local_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    ship(session)
    yield session
    session.stop()


DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings page_blocks parent_chunks child_chunks sessions session_turns eval_questions mix_targets".split()


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con
