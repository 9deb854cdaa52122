import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cl-test-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    yield s


def mask_cases(spark, cases, rules, entities=None):
    """Mask many independent texts in one job: each case is its own scope
    (a fresh registry).  Returns (texts, mappings)."""
    from cloakline.plans.jobs import mask

    rows = [(i, 0, t) for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "case long, seq long, text string")
    r = mask(df, "text", ["seq"], ["case"], rules=rules, entities=entities)
    out = dict(r.masked.select("case", "text").collect())
    maps = {}
    for case, p, o in r.mapping.select("case", "pseudonym", "original").collect():
        maps.setdefault(case, {})[p] = o
    return [out[i] for i in range(len(cases))], [maps.get(i, {}) for i in range(len(cases))]
