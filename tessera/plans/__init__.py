"""Whole plans: registered queries, the linkage pipeline and its command line."""
