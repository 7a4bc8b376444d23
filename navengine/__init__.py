"""navengine: analytics on daily price series as Spark DataFrame transformations."""
