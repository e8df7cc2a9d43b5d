import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "readloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"readloom\.llm|from readloom import llm", path.read_text()), path


def test_jobs_survive_lost_executors():
    for path in [*ROOT.glob("*.py"), *(ROOT / "readloom").rglob("*.py")]:
        assert "localCheckpoint(" not in path.read_text(), path


def test_every_query_that_needs_no_brute_force_has_sql():
    from readloom.plans.queries import QUERIES

    assert all(sql.strip() for _, sql in QUERIES.values())
