"""Knowledge-graph analytics over change events from personal sources, as Spark DataFrame plans."""
