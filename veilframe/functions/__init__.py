"""Column builders and the few Python functions Spark lacks."""
