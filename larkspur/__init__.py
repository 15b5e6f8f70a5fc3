"""Keyed JSON documents, leases, queues and training-data operators on PySpark."""
