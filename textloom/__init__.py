"""textloom: text, vector, web, code and conversation analytics as plain PySpark.

Every operator is a function from DataFrame to DataFrame, so Catalyst plans the
whole pipeline.  Training-data operators live in the optional subpackage
``textloom.llm``; nothing else in the package imports it.
"""

__version__ = "0.1.0"
