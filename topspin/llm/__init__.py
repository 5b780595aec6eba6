"""Training-data operators: tokenisation, quality, duplicates, extraction, archives and search.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
