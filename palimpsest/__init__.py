"""Time-stamped visual text as DataFrames: frames, boxes, recognised lines, segments, and their metrics, on Spark."""
