"""logloom: log triage as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Rows are addressed by
``(source_id, rid)``; tags and notes are ordinary tables keyed the same way.
"""
