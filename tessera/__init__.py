"""tessera: multimodal feature-table and model-evaluation operators on Spark.

Every operator takes and returns DataFrames; nothing is pulled through the
driver except small, size-bounded parameter rows (class lists, per-feature
statistics).
"""

__version__ = "0.1.0"
