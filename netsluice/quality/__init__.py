"""Declarative quality rules, reports and gates."""
