"""poolsieve: a Spark-first engine for curating image-text pools and scoring models on them."""
