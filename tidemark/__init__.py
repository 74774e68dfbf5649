"""Asset-lifecycle, demand and knowledge-base jobs as Spark DataFrame code."""
