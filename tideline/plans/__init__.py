"""Part of tideline: plans."""
