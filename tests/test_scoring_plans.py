"""What the plans of scored hand-overs must not hold, since candidates are many: seen without broadcasts."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.functions import search, slices
from gridloom.operators import ranking
from gridloom.plans import catalog
from gridloom.sources import projections

from .conftest import SMALL


@pytest.fixture
def around(spark):
    """The parts of a query's plan above and below the kernel that scores."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_candidates_are_no_rows_before_they_are_scored(around):
    above, below = around("handover_scores")
    assert "Generate" not in below and "explode" not in below
    assert "Project" not in above


def test_a_best_candidate_is_chosen_among_rows_of_its_own_value():
    t = {"score": np.array([0.5, 0.9, 0.9, 0.9, 0.1])}
    assert slices.best(t, np.array([1, 3, 2, 2, 0]), np.array([1, 1, 5, 4, 0]), np.array([4, 8, 8, 8, 4])).tolist() == [3]
    nothing = np.array([], dtype=np.int64)
    assert slices.best({"score": np.array([])}, nothing, nothing, nothing).tolist() == []


def test_the_best_hand_over_is_chosen_without_a_sort_of_candidates(around):
    above, _ = around("handover_best")
    assert "Window" not in above and "Sort" not in above


@pytest.mark.parametrize("name", ["transition_plans", "simple_plans"])
def test_plans_are_made_of_best_candidates_alone(around, name):
    above, _ = around(name)
    assert "Window" not in above and "Sort" not in above


def test_candidates_bring_their_roles_along(around):
    above, _ = around("rendering_styles")
    assert "Join" not in above


def test_a_beam_search_is_one_pass_over_queues(spark):
    """The walk on arrays finds the paths of the search on rows, and no queue waits for a level of others."""
    queue = projections.queue(spark, SMALL, 12)
    edges, energies = ranking.edge_scores(queue).cache(), ranking.energies(queue)
    rows = {r.queue_id: r.path for r in ranking.beam_order(edges, energies, 12, width=12).collect()}
    assert {r.queue_id: r.path for r in ranking.beam_queue(queue, width=12).collect()} == rows
    df = catalog.QUERIES["beam_order"](spark, SMALL)
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_as_words_sort_alike():
    rng = np.random.default_rng(1)
    for n, items in ((5, 5), (12, 12), (20, 20), (40, 25)):
        paths = np.array([rng.permutation(n)[:items] for _ in range(200)])
        f = search.Frontier(paths, np.zeros(200), np.zeros(200), np.zeros(200))
        assert paths[f.order(f.value)].tolist() == sorted(paths.tolist(), reverse=True)
