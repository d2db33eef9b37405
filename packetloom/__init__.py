"""Traffic-forensics analytics on PySpark."""
