"""Interaction-sequence analytics and retrieval evaluation on Spark."""
