"""Results do not depend on the number of task slots: training gives the same
answer on one slot, and a gang that does not fit says so."""

import os
import subprocess
import sys
import textwrap

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent("""
    import sys
    sys.path.insert(0, %r)
    from pyspark.sql import SparkSession
    from tessera.plans.queries import QUERIES
    from tessera.session import ship_package
    spark = (SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
    ship_package(spark)
    sf = "/root/testdata/sf0.001"
    print("STEPS", sorted((r.step, r.loss_ok) for r in QUERIES["train_history"](spark, sf).collect()))
    try:
        QUERIES["gang_sum"](spark, sf).collect()
        print("GANG ran")
    except ValueError as e:
        print("GANG", e)
""") % ROOT


@pytest.mark.parametrize("slots", [1, 2])
def test_few_slots(slots):
    r = subprocess.run([sys.executable, "-c", SCRIPT, f"local[{slots}]"], capture_output=True, text=True, timeout=900)
    out = {x.split()[0]: x.split(maxsplit=1)[1] for x in r.stdout.splitlines() if x[:5] in ("STEPS", "GANG ")}
    assert out["STEPS"] == str([(s, True) for s in (0, 5, 10, 15, 19)]), r.stderr[-2000:]
    assert out["GANG"] == f"a gang of 3 needs 3 free task slots; the cluster has {slots}"
