"""tideline: a Spark-first engine for multichannel signal features and corpus curation."""
