"""Pipelines of operators: built fluently, validated, explained, and run as one lazy plan."""
