"""Whole plans made of operators: search comparison, ingestion, evaluation."""
