import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["arxiv_id", "score"] and df.count() > 0


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "rag_topk" in sql


def test_without_the_training_data_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "litspark", tmp_path / "litspark", ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rag_topk' in q and not any(n.startswith('p1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})


def test_a_missing_library_leaves_the_core(tmp_path):
    code = (
        "import sys, warnings; sys.modules['zstandard'] = None; import __spark_entry__ as e; warnings.simplefilter('error'); "
        "q = {}\ntry:\n    e.queries()\nexcept UserWarning as w:\n    assert 'zstandard' in str(w)\nelse:\n    assert not __import__('pathlib').Path('litspark/llm').exists()\n"
        "warnings.simplefilter('ignore'); q = e.queries(); assert 'rag_topk' in q"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})


class Cluster:
    """As much of a session as the choice of a folder asks for."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    from litspark.config import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster, "x")


def test_core_does_not_import_them():
    for f in (ROOT / "litspark").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "litspark.llm" not in f.read_text(), f
