"""Operators: functions from frames to frames over long-form matrices, graphs and labels."""
