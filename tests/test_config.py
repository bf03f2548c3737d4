"""Settings: bounds, types and what the environment overrides."""

import pytest

from marginalia.config import ConfigurationError, Settings, _parsed


def test_defaults_and_bounds():
    assert Settings() == Settings(top_k=5, graph_depth=2, min_score=0.25, max_graph_facts=20, max_retries=2, retry_k_step=3)
    assert Settings(min_score=1).min_score == 1 and Settings(top_k=100, graph_depth=5, max_retries=0).max_retries == 0
    for wrong in ({"top_k": 0}, {"top_k": 101}, {"top_k": 2.0}, {"top_k": True}, {"graph_depth": 6}, {"min_score": -0.1}, {"min_score": "0.5"},
                  {"max_graph_facts": 0}, {"max_retries": 3}, {"retry_k_step": -1}, {"top_k": None}):
        with pytest.raises(ConfigurationError, match=next(iter(wrong))):
            Settings(**wrong)


def test_environment():
    made = Settings.from_env({"RETRIEVAL_TOP_K": " 7 ", "RETRIEVAL_MIN_SCORE": "0.5", "QUERY_MAX_RETRIES": "", "OTHER": "x"})
    assert made == Settings(top_k=7, min_score=0.5)
    for env in ({"RETRIEVAL_TOP_K": "many"}, {"RETRIEVAL_GRAPH_DEPTH": "2.5"}, {"RETRIEVAL_MAX_GRAPH_FACTS": "500"}):
        with pytest.raises(ConfigurationError):
            Settings.from_env(env)


def test_switches():
    assert [_parsed("X", t, bool) for t in ("Yes", "off", "1", "FALSE")] == [True, False, True, False]
    with pytest.raises(ConfigurationError, match="a switch"):
        _parsed("X", "maybe", bool)
