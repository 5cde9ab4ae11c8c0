"""Registered queries run with the operators' own iterations and evaluation."""

import pytest

from crewmetrics.operators import themes
from verification import queries


class Reached(Exception):
    pass


@pytest.mark.parametrize("query, operator", [(queries.theme_terms, "fit_themes"), (queries.themes_nmf, "survey_themes")])
def test_themes_with_the_default_iterations(spark, monkeypatch, query, operator):
    given = {}

    def stop(*args, **names):
        given.update(names)
        raise Reached

    monkeypatch.setattr(themes, operator, stop)
    with pytest.raises(Reached):
        query(spark, "/root/testdata/sf0.001")
    assert not {"max_iter", "tolerance"} & given.keys()


def test_training_queries_evaluate(spark):
    trained, _ = queries._trained(spark, "/root/testdata/sf0.001", queries.model.LINEAR)
    assert trained.metrics["auc"] is not None and trained.metrics["classification_report"]
