import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chatterloom.operators.blocks import SplitPolicy  # noqa: E402
from chatterloom.session import local_session  # noqa: E402

# Cuts nearly every key, so small test data takes the path of huge keys.
SPLIT_ALL = SplitPolicy(sample_mod=2, min_cuts=1, max_cuts=1 << 20)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def policy(request):
    return SplitPolicy() if request.param == "whole" else SPLIT_ALL


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def make_threads(spark, threads):
    """Messages of several threads from ``(type, content, calls, blocks)`` tuples."""
    from chatterloom.schemas import TABLES

    data = []
    for thread, items in threads.items():
        for position, item in enumerate(items):
            kind, content, calls, blocks = (*item, None, None)[:4]
            data.append((thread, position, f"{thread}-{position}", kind, content, blocks, calls, None))
    return spark.createDataFrame(data, TABLES["message"])


def make_messages(spark, items, thread="t"):
    return make_threads(spark, {thread: items})
