"""Build and evaluate text-retrieval collections on Spark."""

from ridgeline.workers import make_importable

make_importable()
