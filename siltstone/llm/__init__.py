"""Operators for training-data text; nothing outside this folder imports them."""
