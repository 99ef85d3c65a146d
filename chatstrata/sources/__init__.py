"""Reading archives from disk and writing them back."""
