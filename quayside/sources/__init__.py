"""Table sources, adapter views, document folders and snapshot writes."""
