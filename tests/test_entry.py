import subprocess
import sys

import __spark_entry__ as entry
from tidemark import plans


def test_smoke_query(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


def test_the_entry_point_works_without_the_text_operators():
    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rollup_hourly' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_nothing_but_the_entry_point_imports_the_text_operators():
    code = "import sys; import tidemark.plans, tidemark.streaming.views; assert not any(m.startswith('tidemark.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
