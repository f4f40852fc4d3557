import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shardloom.session import local_session  # noqa: E402

SHARDS = "split string, shard_index int, token_count int, tokens array<int>"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, partitions=4, **{"spark.checkpoint.dir": folder, "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shard_table(spark):
    def make(split, lists):
        rows = [(split, i, len(tokens), [int(t) for t in tokens]) for i, tokens in lists.items()]
        return spark.createDataFrame(rows, SHARDS)

    return make


@pytest.fixture
def shard_file():
    """Writes a shard byte by byte, independently of the writer under test."""

    def write(path, tokens, magic=20240520, version=1, count=None, words=256):
        header = np.zeros(words, dtype="<i4")
        header[:3] = magic, version, len(tokens) if count is None else count
        path.write_bytes(header.tobytes() + np.asarray(tokens, dtype="<u2").tobytes())

    return write
