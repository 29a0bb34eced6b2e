"""Registered queries: operators bound to views over the driver's tables, with DuckDB SQL."""
