"""A query makes each profile once, however many rules read it."""
import pytest

from meshwork.operators import profile as P
from meshwork.plans.registry import load_all

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query,most", [("recommendations", 4), ("compliance_checks", 5), ("compliance_history", 5)])
def test_profiles_are_made_once(spark, monkeypatch, query, most):
    # the contract of orders, of compliance also customer and part, and the views' stored facts
    made, profile = [], P.column_profile
    monkeypatch.setattr(P, "column_profile", lambda df, *a, **k: made.append(df.columns[0]) or profile(df, *a, **k))
    load_all()[0][query](spark, SF)
    assert 1 <= len(made) <= most
