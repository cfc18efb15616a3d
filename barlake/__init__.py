"""Market-data analytics as Spark DataFrame transformations over one long table of all instruments."""
