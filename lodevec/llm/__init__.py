"""Operators for preparing large text corpora, each a Spark job over whole tables.

Nothing outside this folder imports it except the top-level entry modules.
"""
