"""Intermediate tables, as the rest of the package stores them."""

from pagelens.storage import BATCH_BYTES, discard, shared_folder, small_batches, stored  # noqa: F401
