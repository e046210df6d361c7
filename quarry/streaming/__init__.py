"""The table operators on unbounded input (Structured Streaming).

The reference works on finished tables only; these run the same operators
on a stream: running column statistics and cross-tabulations (native
stateful aggregations), the line-chart series over event-time windows with
a watermark, and the per-row operators with statistics frozen from a batch
table (scaling, outlier mask, nearest-centre assignment, prediction).
"""
