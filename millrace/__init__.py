"""millrace: data profiling, cleaning and corpus preparation as Spark plans."""
