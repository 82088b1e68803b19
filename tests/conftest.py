import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from spotflow.schema import DETECTION  # noqa: E402

T0 = dt.datetime(2024, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Detections from short dicts: seconds ``s`` after T0, type, and what differs."""

    def make(*items):
        out = []
        for i, item in enumerate(items):
            base = {
                "id": f"{i:04d}", "type": "moving", "license": "A1", "site": "G", "level": "P1", "spot": None,
                "sensor": "C1", "object_id": "o1", "x": 0.0, "y": 0.0, "video": "",
            }
            base.update(item)
            base["ts"] = T0 + dt.timedelta(microseconds=round(base.pop("s") * 1e6))
            out.append(tuple(base[f.name] for f in DETECTION.fields))
        return spark.createDataFrame(out, DETECTION)

    return make
