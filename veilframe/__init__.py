"""veilframe: pseudonymisation, identity and record linkage as Spark DataFrame transformations."""
