"""Training-data operators: ten corpus-scale jobs over documents, pages and benchmark tables."""
