"""affinis: affiliation strings to institution ids, as Spark DataFrame jobs."""
