"""quire: document elements as Spark DataFrames.

Every operator takes DataFrames and returns DataFrames.  Elements are rows keyed
``(doc_id, element_index)``; see :mod:`quire.schema` for the full column list.
"""

__version__ = "0.1.0"
