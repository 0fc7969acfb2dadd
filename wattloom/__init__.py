"""wattloom: household electricity and solar analytics as Spark DataFrame operators."""
