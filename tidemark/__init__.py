"""Event-study and market-analytics operators written as Spark DataFrame jobs."""
