"""Code-intelligence property graphs on Spark: build node and edge tables, and ask fixed graph questions of them."""
