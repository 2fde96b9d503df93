"""Fleet-wide analytics over pools of shared interactive servers, written for Spark."""
