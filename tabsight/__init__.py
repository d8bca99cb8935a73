"""tabsight: explainable risk analytics on tabular data, expressed as Spark DataFrame operators."""
