import sys

import pytest
from pyspark.sql import functions as F

from evalspark.operators import reports, scoring
from evalspark.operators.modules import load_scorers
from evalspark.operators.paging import Pages


def test_pages_equal_offset_and_open_few_ranges(spark, tmp_path):
    df = spark.range(5_000).select("id", F.when(F.col("id") % 50 != 0, F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=F.col("id") % 90)).alias("created_at"))
    pages = Pages.store(df, str(tmp_path / "p"), rows=100)
    assert pages.total().first().total == 5_000
    for number, size in ((1, 10), (7, 15), (334, 15), (500, 10), (501, 10), (3, 700)):
        want = reports.page(df, number, size)[0].collect()
        page = pages.page(number, size)
        assert page.collect() == want
        assert len(page.inputFiles()) <= size // 50 + 3 < 50
    with_more = spark.createDataFrame([], df.schema)
    none = Pages.store(with_more, str(tmp_path / "none"))
    assert none.page(1).count() == 0 and none.total().first().total == 0


MODULE = '''
from evalspark.operators.scoring import register_python_scorer, register_scorer, outcome, bad_unless
from pyspark.sql import functions as F

def longer(messages, output, reference):
    return {"score": float(len(output) > len(reference)), "details": {"file": __file__}}

register_python_scorer("%(name)s_longer", longer)

@register_scorer("%(name)s_same")
def same(case):
    """Equal texts."""
    return outcome((case.model_output == case.reference_output).cast("double"), F.lit(0), F.lit(None).cast("string"))
'''


@pytest.fixture
def registry():
    before = scoring.registered()
    yield
    scoring.restore(before)


def test_scorers_of_a_module_outside_the_path(spark, tmp_path, registry):
    path = tmp_path / "outside" / "my_house_scorers.py"
    path.parent.mkdir()
    path.write_text(MODULE % {"name": "house"})
    assert str(path.parent) not in sys.path
    assert load_scorers(spark, str(path)) == ["house_longer", "house_same"]
    df = spark.createDataFrame([(k, "x" * k, "xxx") for k in range(6)], "index long, model_output string, reference_output string").repartition(3)
    got = scoring.score(df, "house_longer").orderBy("index").collect()
    assert [r.score for r in got] == [0.0] * 4 + [1.0] * 2
    # The executors ran the shipped copy, not the file on the driver.
    assert all("my_house_scorers" in r.details and str(path.parent) not in r.details for r in got)
    assert [r.score for r in scoring.score(df, "house_same").orderBy("index").collect()] == [0, 0, 0, 1, 0, 0]


def test_missing_and_broken_modules_warn(spark, tmp_path, registry):
    before = scoring.registered()
    with pytest.warns(UserWarning, match="not found"):
        assert load_scorers(spark, str(tmp_path / "nowhere.py")) == []
    broken = tmp_path / "my_broken_scorers.py"
    broken.write_text(MODULE % {"name": "broken"} + "\nraise ValueError('half-way')\n")
    with pytest.warns(UserWarning, match="half-way"):
        assert load_scorers(spark, str(broken)) == []
    assert scoring.registered() == before and "my_broken_scorers" not in sys.modules
    (tmp_path / "json.py").write_text("")
    with pytest.warns(UserWarning, match="exists already"):
        assert load_scorers(spark, str(tmp_path / "json.py")) == []
