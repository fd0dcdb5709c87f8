"""Low-rank block matrices and tensors as Spark jobs."""

import os

# Tasks are Spark's parallelism: one thread for the array library of each process, which also keeps it safe to fork.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
