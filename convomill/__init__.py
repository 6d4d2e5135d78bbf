"""Conversation mining and near-duplicate analytics as Spark DataFrame operators."""
