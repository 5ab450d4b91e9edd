"""Land-record and cadastral analytics as Spark dataflows."""
