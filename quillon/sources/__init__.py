"""Readers of count matrices into long form: (feature_id, cell_id, value), zeros absent."""
