"""Product-text analytics and corpus preparation on Spark."""
