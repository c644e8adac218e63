"""Part of tideline: sources."""
