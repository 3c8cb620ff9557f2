"""Logical plans: rules, validation, suggestions, snapshots, decisions, reports."""
