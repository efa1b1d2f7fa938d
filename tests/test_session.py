"""Session independence: time zone and cluster-profile configuration."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL
from orderlens.operators import experience
from orderlens.plans import reports
from orderlens.plans.model import SalesModel


def test_results_do_not_depend_on_session_time_zone(spark):
    """Timestamps are timestamp_ntz end to end, so a session time zone with daylight saving
    changes neither floor days nor periods."""
    old = spark.conf.get("spark.sql.session.timeZone")
    results = []
    try:
        for tz in ("UTC", "America/Sao_Paulo", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            m = SalesModel.from_fixtures(spark, SF_SMALL)
            kpi = reports.kpi_report(m, 2000).collect()
            days = experience.delivery_metrics(m.sales).groupBy("delivery_speed").count().orderBy("delivery_speed").collect()
            results.append((kpi, days))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert results[0] == results[1] == results[2]


def test_cluster_profile_keeps_launch_settings(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from orderlens.session import get_spark\n"
        "s = get_spark(profile='cluster', master='local[2]')\n"
        "print('RESULT', s.conf.get('spark.sql.shuffle.partitions'), "
        "s.conf.get('spark.sql.adaptive.advisoryPartitionSizeInBytes'))\n"
        "s.stop()\n"
    ) % ROOT
    env = dict(os.environ)
    env["PYSPARK_SUBMIT_ARGS"] = "--conf spark.sql.shuffle.partitions=123 --conf spark.ui.enabled=false pyspark-shell"
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    line = [l for l in out.stdout.splitlines() if l.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, partitions, advisory = line[0].split()
    assert partitions == "123"  # set at launch: kept
    assert advisory.lower() in ("256m", "268435456b", "268435456")  # unset at launch: profile value
