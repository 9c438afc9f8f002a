"""gridwork: spreadsheet analytics as Spark jobs."""
