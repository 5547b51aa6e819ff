"""Folders of the given tables, for tests (a plain module: a second conftest.py would shadow names kept in the first)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
