import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from crawlgrid import get_spark
    ckpt = str(tmp_path_factory.mktemp("ckpt"))
    s = get_spark("local[4]", app="crawlgrid-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
