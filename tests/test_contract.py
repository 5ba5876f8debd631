"""The driver contract in a separate process with a plain session (no chainlens defaults)."""

import json
import os
import subprocess
import sys

SCRIPT = r"""
import json, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
out = {"entry_cols": E.entry(spark).columns, "entry_rows": E.entry(spark).count()}
for name in ["revenue_by_customer_key", "plant_efficiency", "revenue_summary", "sampled_supplier_ids"]:
    out[name] = E.queries()[name](spark, "/root/testdata/sf0.001").count()
out["n_queries"] = len(E.queries())
out["n_oracle"] = len(E.oracle_sql())
print("RESULT" + json.dumps(out))
spark.stop()
"""


def test_contract_in_plain_session():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    p = subprocess.run([sys.executable, "-c", SCRIPT, repo], capture_output=True, text=True, timeout=600, cwd="/tmp")
    line = next(x for x in p.stdout.splitlines() if x.startswith("RESULT"))
    out = json.loads(line[len("RESULT"):])
    assert out["entry_cols"][0] == "customer" and out["entry_rows"] > 0
    assert out["n_queries"] >= out["n_oracle"] > 70
    assert all(out[k] > 0 for k in ("revenue_by_customer_key", "plant_efficiency", "revenue_summary",
                                     "sampled_supplier_ids"))
