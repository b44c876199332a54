"""Training-data operators: one module per operator, thin queries in ``queries``.

Nothing outside this folder imports it, apart from the driver contract files
(``__spark_entry__`` and ``corpus_pipeline``).
"""
