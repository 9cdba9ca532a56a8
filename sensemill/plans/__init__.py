"""Registered queries, each with its DuckDB SQL."""
