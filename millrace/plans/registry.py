"""Imports every module that registers queries."""

from millrace.plans import benchmark, building, corpus, dialogues, records, scores, texts  # noqa: F401
