"""LAS and LAZ files: headers, records, codecs, and a Spark data source."""
