"""Page, record and text analytics as Spark DataFrame operators."""
