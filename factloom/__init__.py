"""Architecture-fact analytics on Spark: fact tables, graph operators and training-data operators."""
