"""Views over tables and the pack pipeline."""
