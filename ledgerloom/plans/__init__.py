"""Composite plans: the mart, its views, exports and reports."""
