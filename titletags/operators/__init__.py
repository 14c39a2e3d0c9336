"""Operators: functions from DataFrame to DataFrame, free of actions."""
