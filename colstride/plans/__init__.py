"""Whole queries, and the harness that runs variants of one."""
