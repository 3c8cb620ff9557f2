"""Generic distributed operators: kNN text join, fuzzy candidate joins, keyed upsert, paging."""
