"""Whole-corpus pipelines and the registered queries."""
