"""Change-impact analytics on Spark: graphs, intervals, similarity, evidence, evaluation, queues."""
