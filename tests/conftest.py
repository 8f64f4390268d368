import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lagwell.plans.scale import session

    s = session("tests", cores="8", shuffle_partitions=4,
                spark__sql__streaming__stateStore__providerClass=(
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *keys):
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else out


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(float(a) - float(b)) <= tol * max(1.0, abs(float(a)))
    return a == b
