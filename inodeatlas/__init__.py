"""File-system metadata analytics on Spark DataFrames.

Snapshots become a per-file table and per user, group and directory summaries;
change logs become an update and delete feed.
"""

__version__ = "0.1.0"
