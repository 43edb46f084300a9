"""Video-caption feature and evaluation analytics as Spark DataFrame operators."""
