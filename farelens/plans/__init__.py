"""Composite plans (dashboard, home page, search page) and the query catalog."""
