"""Spark-native engine for timed, positioned text.

Subpackages: ``operators`` (relational and timeline operators), ``functions``
(scalar functions), ``sources`` and ``sinks`` (binary subtitle streams, JSON
manifests, subtitle text), ``raster`` (NumPy kernels behind Arrow UDFs),
``plans`` (requests and whole pipelines), ``streaming`` (stateful variants) and
``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
