"""Part of tideline: streaming."""
