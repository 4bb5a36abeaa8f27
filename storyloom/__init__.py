"""storyloom: narrative-text analytics as Spark DataFrame plans."""
