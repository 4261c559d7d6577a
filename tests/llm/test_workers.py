"""Executors without a copy of the package: what is sent to them must not name its modules."""

import os
import pickletools
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from terrafold.llm import lang_id

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

RUN = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {root!r})
from terrafold.llm.queries import QUERIES
rows = QUERIES["op1_language_id"](spark, {sf!r}).collect()
assert rows and all(r.lang_pred for r in rows)
"""


def test_model_travels_by_value():
    x = np.stack([lang_id.features(t) for t in ("the cat and the dog", "der Hund und die Katze", "el perro y el gato")])
    sent = cloudpickle.dumps(lang_id.fit(x, ["en", "de", "es"]))
    modules = {a for _, a, _ in pickletools.genops(sent) if isinstance(a, str) and a.startswith("terrafold.llm.lang_id ")}
    assert not modules
    code = "import pickle, sys; m = pickle.load(sys.stdin.buffer); assert 'terrafold' not in sys.modules and len(m.families) == 2"
    subprocess.run([sys.executable, "-c", code], input=sent, check=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_runs_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert got.returncode == 0, got.stderr[-2000:]
