"""Loads every query module; ``QUERIES`` and ``SQL`` are complete after this import."""

from mailsift.plans import (  # noqa: F401
    evaluation_queries,
    pipeline_queries,
    policy_queries,
    sender_queries,
    similarity_queries,
    text_queries,
    training_queries,
)
from mailsift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
