"""Operators for preparing training data. Nothing else in the library imports this package.

Submodules hold one operator each: its functions, its query over the synthetic tables, and its SQL where SQL
can express it. ``registry`` collects the queries."""
