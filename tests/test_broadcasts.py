"""Tables as long as the corpus are merged: the planner's guess of their size isn't followed."""

import os

import pytest

from qanat.functions import session
from qanat.operators import conversations
from qanat.plans import catalog
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", ["gate_decisions", "gate_summary", "conversation_corpus_flags", "conversation_decisions"])  # conversation_gate_report joins behind stored tables, by the code of conversation_decisions
def test_only_counted_tables_are_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0, raising=False)
    plan = catalog.queries()[name](spark, compare.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kinds_of_flags_are_found_one_after_the_other(spark, monkeypatch):
    """The driver plans no two kinds of flags at once: each is stored, by a plan that broadcasts nothing, and the decisions read what is stored."""
    plans = {}

    def stored(df):
        ran = df._jdf.queryExecution()
        kinds = [code for code in corpus if f"{code} AS code" in ran.optimizedPlan().toString()]
        plans.update({code: (kinds, ran.executedPlan().toString()) for code in kinds})
        return session.stored(df)

    corpus = ["unscannable_messages", "heldout_eval_phrase_overlap", "repeated_templated_opening", "suspicious_shared_verbatim_span", "exact_corpus_duplicate", "near_corpus_duplicate"]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(conversations, "stored", stored)
    decided = catalog.queries()["conversation_decisions"](spark, compare.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert decided.count("Exchange ") <= 3 and not any(code in decided for code in corpus)
    assert sorted(plans) == sorted(corpus) and all(kinds == [code] and "Broadcast" not in plan for code, (kinds, plan) in plans.items())
