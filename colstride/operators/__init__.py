"""Operators over columns and positions, each a composition of DataFrame operations."""

from .aggregate import agg_sum, agg_sum_grouped
from .calc import calc, calc_binary, calc_unary, compare, compare_binary, increment
from .grouping import distinct_values, group, group_refine
from .joins import hash_join, hash_semi_join, left_semi_join, nested_loop_join
from .projection import project
from .selection import between, select, select_all, select_any
from .sets import intersect_sorted, merge_sorted

__all__ = [
    "agg_sum", "agg_sum_grouped", "between", "calc", "calc_binary", "calc_unary", "compare", "compare_binary", "distinct_values",
    "group", "group_refine", "hash_join", "hash_semi_join", "increment", "intersect_sorted", "left_semi_join",
    "merge_sorted", "nested_loop_join", "project", "select", "select_all", "select_any",
]
