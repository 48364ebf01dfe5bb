"""Questions about a sheet: columns, counts where they are asked for, samples, odd sheets."""

import pytest

from docloom.operators import tabular

ROWS = [("China", "Gold", 3), ("China", "Silver", 1), ("Japan", "Gold", None), ("Japan", "Gold", 2), ("Kenya", None, 5), ("Kenya", "Gold", 4)]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(ROWS, "Team string, Medal string, Age int")


def found(df, section):
    return sorted(((r.position, r.column, r.value, r.n) for r in df.collect() if r.section == section), key=str)


def test_counts_only_where_asked(sheet):
    columns = ["Team", "Medal", "Age"]
    shown = tabular.search_sheet(sheet, "国家", columns)
    assert found(shown, "column") == [(1, "Team", "string", 3)]
    assert found(shown, "top") == [(1, "Team", "China", 2), (2, "Team", "Japan", 2), (3, "Team", "Kenya", 2)]
    assert not found(shown, "group") and not found(shown, "sample")
    counted = [tabular.search_sheet(sheet, "统计国家", columns), tabular.search_sheet(sheet, "国家", columns, "aggregate")]
    for c in counted:
        assert found(c, "group") == [(1, "Team", "China", 2), (2, "Team", "Japan", 2), (3, "Team", "Kenya", 2)]
    gold = tabular.search_sheet(sheet, "统计 team medal gold", columns)  # few values each: the first is the group, the next holds the value
    assert found(gold, "group") == [(1, "Medal", "Gold", 4), (2, "Medal", None, 1), (3, "Medal", "Silver", 1)]


def test_samples(sheet):
    got = found(tabular.search_sheet(sheet, "age", ["Team", "Medal", "Age"], "sample", sampled=3), "sample")
    assert got == [(1, "Age", "1", 2), (1, "Age", "2", 3), (1, "Age", None, 1)]
    every = found(tabular.search_sheet(sheet, "nothing", ["Team", "Medal"], "sample", sampled=100), "sample")
    assert len(every) == 2 * len(ROWS)
    with pytest.raises(ValueError):
        tabular.search_sheet(sheet, "age", ["Age"], "other")


def test_findings_and_empty_sheets(spark, sheet):
    mostly = spark.createDataFrame([(None, "x")] * 6 + [("a", "x")], "a string, b string")
    assert found(tabular.search_sheet(mostly, "a b", ["a", "b"]), "finding") == [(1, "a", "constant", None), (2, "a", "high_null", None), (3, "b", "constant", None)]
    none = tabular.search_sheet(sheet.limit(0), "统计国家", ["Team", "Age"], "sample")
    assert sorted((r.section, r.column, r.value, r.n) for r in none.collect()) == [("column", "Team", "empty", 0)]
