"""kernmill: a PySpark engine for knowledge-graph and encyclopedia corpora.

Layout: ``sources`` read dumps and tables, ``functions`` hold column
expressions and Arrow UDFs, ``operators`` are DataFrame-to-DataFrame
building blocks, ``plans`` compose them into queries and reports,
``streaming`` holds incremental variants, ``wikitext`` the markup engine.
"""

__version__ = "0.1.0"
