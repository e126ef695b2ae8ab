"""voxmill: office-speech corpus engineering on PySpark.

Sub-packages: ``functions`` (column expressions and array kernels), ``sources`` (scans and
decoders), ``operators`` (relational and ordered-state operators), ``streaming`` (checkpointed
jobs), ``plans`` (the query catalogue) and ``llm`` (training-data operators, optional).
"""

__version__ = "0.1.0"
