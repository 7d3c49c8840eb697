"""Evaluation metrics over tables of predictions."""
