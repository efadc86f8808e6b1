"""Operators for preparing training text: tokens, duplicates, quality, licences, mixing, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
