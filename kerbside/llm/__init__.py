"""Operators of a training-data pipeline: near-duplicate joins, token files,
classifiers, document rules, decontamination, packing, URL rules and sharding.

Nothing outside this folder imports it (``__spark_entry__`` adds its queries
only when it is present)."""
