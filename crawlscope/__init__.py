"""Site index and crawlability audit over tables of fetched documents, as Spark jobs."""
