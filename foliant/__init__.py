"""Document-structure analytics on Spark: DataFrame-first operators over text blocks, nodes and reports."""
