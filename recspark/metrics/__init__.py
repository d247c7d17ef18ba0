"""Evaluation of predictions and rankings."""
