"""mnemora: retrieval and analytics over a knowledge store, as Spark DataFrame operators."""
