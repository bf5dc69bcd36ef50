"""Whole workflows put together from the operators."""
