"""Whole pipelines and the catalogue of registered queries."""

from __future__ import annotations

import importlib


def load_queries():
    from threatlake.plans.registry import QUERIES, cut_twins

    for module in ("catalogue", "catalogue_reports", "catalogue_models", "catalogue_streams", "catalogue_incremental"):
        importlib.import_module(f"threatlake.plans.{module}")
    cut_twins("m1_behaviour6", "w11_sequence_deviation", "v1_action_validation", "k8_action_choice", "j11_similar_cases")
    return dict(QUERIES)
