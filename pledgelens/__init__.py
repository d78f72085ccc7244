"""Promise-versus-actual analytics as lazy PySpark DataFrame operators."""
