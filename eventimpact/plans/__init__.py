"""Registered queries: each key pairs a DataFrame-API plan with an independent DuckDB SQL oracle."""
