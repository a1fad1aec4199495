import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(r.bound_ok and r.true_card <= r.dsb <= r.maxfreq for r in rows)
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)


def test_without_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('rowceil.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
