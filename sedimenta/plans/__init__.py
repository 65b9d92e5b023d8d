"""Compositions of operators: merge plans, migrations, reports."""
