"""Relational operators over inventories, rules, settings, runs and history."""
