import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clinops.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    wh = tempfile.mkdtemp(prefix="clinops-wh-")
    s = get_spark(8, shuffle_partitions=8, app_name="clinops-tests",
                  extra_conf={"spark.sql.warehouse.dir": wh})
    yield s


def rows(df, *cols):
    """Collect selected columns as sorted list of tuples."""
    sel = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in sel.collect()], key=lambda t: tuple((x is None, str(x)) for x in t))
