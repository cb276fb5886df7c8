"""mosaiq: a declarative, model-centric query engine on PySpark."""
