"""Constants that test files import: a module of its own, as every conftest.py is the same top-level module."""

SF_SMALL = "/root/testdata/sf0.001"
