"""quarry: table exploration and modelling on Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame (lazy); fitted
statistics are small DataFrames joined back by broadcast of a one-row or
otherwise size-bounded side.  Statistics operators accept ``by=[keys]`` so one
call runs one fit per group.
"""

__version__ = "0.1.0"
