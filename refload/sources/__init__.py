"""Reading and writing of files: delimited text, format descriptors, listings, logs."""
