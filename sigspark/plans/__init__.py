"""Whole workflows (`workflows`), the views that the queries read (`views`), and the queries with their SQL (`queries`)."""
