import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


def say(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_imports_with_and_without_the_optional_parts(tmp_path):
    for name in ("scrub", "__spark_entry__.py", "corpus_pipeline.py"):
        source = f"{ROOT}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    say(tmp_path)
    shutil.rmtree(tmp_path / "scrub/llm", ignore_errors=True)
    assert say(tmp_path).endswith("[]\n")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert say(tmp_path).endswith("[]\n")


def test_flagship_query(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        rows = __spark_entry__.entry(spark).collect()
        assert {r.category for r in rows} >= {"cpf", "cnpj", "email", "cep", "private_ip"}
