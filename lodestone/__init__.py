"""Rule analytics on Spark: programs of facts, imports and rules, compiled to DataFrame plans."""
