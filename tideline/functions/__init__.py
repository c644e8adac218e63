"""Part of tideline: functions."""
