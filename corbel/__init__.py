"""corbel: content-trust analytics and training-data preparation as Spark plans."""
