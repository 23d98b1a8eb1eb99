"""graphev: PySpark jobs over evidence graphs, and over training text in graphev.llm."""
