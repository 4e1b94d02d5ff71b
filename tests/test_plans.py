"""Properties of physical plans that must hold at any scale."""

import re

from codestrata.operators import discovery, stats
from codestrata.sources import views
from codestrata.session import cut_lineage

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_is_applied_before_the_shuffle(spark):
    plan = plan_of(stats.key_files(views.repos(spark, SF)))
    before = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_path_only_producers_do_not_read_content(spark):
    files = cut_lineage(views.repos(spark, SF))
    for make in (discovery.svc_main_go, discovery.svc_package_json, discovery.svc_directory, stats.ext_histogram, stats.folder_count):
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", make(files)._jdf.queryExecution().toString()):
            assert "content" not in schema, make.__name__


def test_filters_reach_the_scan(spark):
    orders = views.table(spark, SF, "events").filter("event_type = 'error'").select("user_id")
    plan = plan_of(orders)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
