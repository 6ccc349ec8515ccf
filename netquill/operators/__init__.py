"""Relational operators over flow, log, alert and prediction tables."""
