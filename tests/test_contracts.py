"""What the code must not do."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "vaporline"
#: Where a bounded result may come to the driver, each with a stated bound.
COLLECTS = {"operators/backbone.py", "operators/graphs.py", "operators/phases.py", "operators/validation.py", "plans/stages.py", "plans/queries_models.py", "plans/queries_windows.py", "plans/queries_profiles.py"}


def sources():
    return {str(p.relative_to(ROOT)): p.read_text() for p in ROOT.rglob("*.py") if not str(p.relative_to(ROOT)).startswith("llm")}


def test_no_fragile_or_row_at_a_time_code():
    for name, text in sources().items():
        assert not re.search(r"localCheckpoint|\.rdd\b|F\.udf\(|@udf|monotonically_increasing_id", text), name


def test_results_come_to_the_driver_only_where_they_are_bounded():
    for name, text in sources().items():
        assert name in COLLECTS or not re.search(r"\.collect\(\)|\.toPandas\(\)|\.toArrow\(\)", text), name


def test_only_one_row_is_cross_joined():
    for name, text in sources().items():
        assert all("broadcast(" in line and ".limit(1)" in line for line in text.splitlines() if ".crossJoin(" in line), name


def test_the_core_stands_alone():
    assert not [n for n, text in sources().items() if "vaporline.llm" in text]
