"""Checks of AI responses as column expressions over DataFrames."""
