"""Readers, writers and stored state: CSV (S1), workbooks (S2), JDBC (S3),
cell encryption (S4, S5), version history (S9-S11)."""
