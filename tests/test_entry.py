import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    return [set(x.split()) for x in out.strip().splitlines()[-2:]]


def test_every_oracle_has_a_query():
    from foliospark.plans.registry import QUERIES
    from foliospark.plans.sql import ORACLES

    queries, oracles = names(ROOT)
    assert oracles <= queries and set(QUERIES) <= queries and set(ORACLES) <= set(QUERIES)


def test_works_without_the_corpus_operators(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=lambda d, fs: [f for f in fs if f in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse")])
    queries, oracles = names(root)
    assert "concentration" in queries and not any(q.startswith("op1") or q == "pipeline" for q in queries | oracles)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
