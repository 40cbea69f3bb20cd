"""Incremental refresh. The pipeline is a periodic batch: there are no event-time streams to express."""
