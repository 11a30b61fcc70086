"""quillspark: text retrieval, vector retrieval and their evaluation as Spark plans."""
