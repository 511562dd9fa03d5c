"""quire: page-document analytics expressed as Spark DataFrame plans."""
