import pytest

from palisade.workspace import Workspace
from test_evidence import book


def test_workspace(spark, tmp_path):
    root = tmp_path / "evidence root"
    for month in ("May 2026", "Jun 2026"):
        (root / month / "NET").mkdir(parents=True)
        (root / month / "NET/a.txt").write_text("Infected files\n3")
    book(root / "May 2026" / "May 2026 checklist.xlsx")
    w = Workspace(spark, str(root), str(tmp_path / "state"))
    assert w.months() == ["Jun 2026", "May 2026"]
    assert [(r.system, r.expected) for r in w.system_tree("May 2026").collect()] == [("RADIO", 1)]
    with pytest.raises(ValueError):
        w.system_tree("Jun 2026")
    w.set_threshold("mcafee", 6000)
    assert w.thresholds()["mcafee"] == 6000.0
    for bad in (-1, "x"):
        with pytest.raises(ValueError):
            w.set_threshold("mcafee", bad)
    status = lambda: w.logs("Jun 2026")["entries"].first().scan_status
    assert status() == "finding_detected"
    w.verify("Jun 2026/NET/a.txt", "safe", "me", "known test file")
    assert status() == "verified_safe"
    (root / "Jun 2026/NET/a.txt").write_text("Infected files\n4")
    assert status() == "finding_detected"
    assert w.summary_of("Jun 2026/NET/a.txt") == "Infected files\n4"
    assert {r.event for r in w.audit().collect()} == {"thresholds.updated", "verification.changed"}
    with pytest.raises(FileNotFoundError):
        w.verify("Jun 2026/NET/none.txt", "safe", "me")
