"""deltaframe: binary deltas between artifacts as Spark DataFrames.

Pairs of artifacts become deltas (copy lists, literals, differences), deltas
become artifacts again, and manifests tell whether a delta can be applied.
"""
