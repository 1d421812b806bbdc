"""opinara: structured-opinion analytics on Spark.

Text records annotated with small closed-vocabulary label maps, the predictions made for them and the
experiments around them, processed as DataFrames.  The subpackages:

- ``sources``    readers and writers,
- ``functions``  column functions and Arrow UDFs (text, parsing, arithmetic),
- ``operators``  scoring, profiling, baselines, retrieval, augmentation, features, experiments,
- ``plans``      helpers that shape physical execution (checkpoints, ranks, components, pair expansion),
- ``streaming``  incremental scoring,
- ``llm``        operators for training-data pipelines; nothing outside it imports it.
"""
