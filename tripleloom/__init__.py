"""tripleloom: a PySpark-native knowledge-graph analytics engine.

Triples are DataFrames, SPARQL compiles to DataFrame plans, and the document,
entity and record steps around the graph are declarative Spark operators.
"""

__version__ = "0.1.0"
