"""typegram: grammars and corpora as relations on Spark."""
