"""Veriloom: a PySpark engine for provenance-retrieval analytics.

Core packages: ``sources`` (readers, writers, manifests), ``functions``
(column expressions and numerical kernels), ``operators`` (DataFrame
operators), ``plans`` (session settings, staging, query catalogue) and
``streaming``. Operators for training-data pipelines live in ``llm``; nothing
outside that subpackage imports it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
