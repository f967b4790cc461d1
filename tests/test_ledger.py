"""The ledger of runs."""
from datetime import datetime, timedelta, timezone

from geoweft.sources import sinks


def test_only_the_newest_runs_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "RUNS_KEPT", 3)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    made = [sinks.record_run(spark, str(tmp_path / "runs"), start + timedelta(days=k), [{"layer": k}], {"v": k}, "broken" if k == 4 else None) for k in range(6)]
    kept = sinks.list_runs(spark, str(tmp_path / "runs"), 10).collect()
    assert [r.id for r in kept] == made[:2:-1] and [r.ok for r in kept] == [True, False, True]
    assert sinks.get_run(spark, str(tmp_path / "runs"), made[0]) is None
    assert sinks.get_run(spark, str(tmp_path / "runs"), made[5])["layers"] == [{"layer": 5}]
