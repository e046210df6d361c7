"""Operators of a training-data pipeline: token counts, quality rules, chat
repair, BPE coding, passage, SimHash and embedding near-dedup, WARC fixity,
sequence packing and secret scans.  Nothing else in ``quarry`` imports this
package."""
