"""Evidence-matching and corpus-preparation operators on PySpark."""
