"""Conversation-memory analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames; nothing is
collected on the driver and nothing is materialised unless its name says so.
"""

from chatterloom.config import CompactionConfig, Wording

__all__ = ["CompactionConfig", "Wording"]
