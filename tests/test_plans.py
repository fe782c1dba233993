
import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_python_on_rows(spark):
    qs = E.queries()
    for key in ["ag_02", "ag_10", "ag_29", "ag_30", "cln_21", "fe_05", "j_02", "w_02"]:
        plan = _plan(qs[key](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key
    for key in ["ag_34", "ag_35"]:
        assert "Pandas" not in _plan(qs[key](spark, SF)) and "Arrow" not in _plan(qs[key](spark, SF))


def test_profile_is_one_scan(spark):
    plan = _plan(E.queries()["ag_38"](spark, SF))
    assert len(re.findall(r"Scan parquet", plan)) == 2      # lineitem + part, once each


def test_first_row_per_product_limits_before_shuffle(spark):
    plan = _optimized(E.queries()["w_01"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_ranks_need_no_exchange_after_the_range_sort(spark):
    for key in ["w_03", "ag_08"]:
        df = E.queries()[key](spark, SF)
        assert "windowspecdefinition(_pid" not in _optimized(df), key
        # only the counts, one row for each partition, are exchanged by it
        for below in re.findall(r"hashpartitioning\(_pid.*\n(.*)", _plan(df)):
            assert "partial_count" in below, key


def test_cells_never_expand_listings(spark):
    for key in ["ag_30", "ag_31", "ag_32", "ag_34", "ag_35", "ag_36", "ag_37", "j_07"]:
        for above in re.findall(r"Generate explode.*\n((?:.*\n)*)", _optimized(E.queries()[key](spark, SF)))[:1]:
            # what is expanded to cells has been counted before
            assert re.search(r"Aggregate \[category", above), key


def test_filters_reach_the_scan(spark):
    df = E.queries()["flt_01"](spark, SF)
    plan = _plan(df)
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)
    assert pushed and "crawl_category" in pushed[1]


def test_only_the_newest_snapshot_is_read(spark):
    df = E.queries()["src_02"](spark, SF)
    assert {f.split("/")[-2] for f in df.inputFiles()} == {"amazon_products_viz_20260324_231228"}
