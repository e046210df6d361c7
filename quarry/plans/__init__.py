"""Registered queries: each operator of the inventory applied to the supplied
tables, with an equivalent DuckDB SQL form where one exists."""
