from vahini.llm import linkage, variants
from vahini.operators import graph
from vahini.session import cut, table


def plans_of(monkeypatch, result):
    """The plans of all cuts on the way and of the result itself."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (linkage, variants, graph):
        monkeypatch.setattr(module, "cut", noted)
    noted(result())
    return plans


def sent_out(plan):
    return [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line and "place_id" not in line and "district" not in line]


def test_p1_puts_no_side_of_a_join_together_on_the_driver(spark, small, monkeypatch):
    plans = plans_of(monkeypatch, lambda: variants.same_firm_pairs(table(spark, small, "contractors")))
    assert len(plans) > 5 and not [x for p in plans for x in sent_out(p)]


def test_p5_puts_no_side_of_a_join_together_on_the_driver(spark, small, monkeypatch):
    plans = plans_of(monkeypatch, lambda: linkage.link(*(table(spark, small, t) for t in ("mjp_projects", "tenders", "place_ref"))))
    assert len(plans) > 3 and not [x for p in plans for x in sent_out(p)]
