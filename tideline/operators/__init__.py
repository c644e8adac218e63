"""Part of tideline: operators."""
