"""quire: document-structure analytics over DataFrames."""
